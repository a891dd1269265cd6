"""Queries over manifests, splits and example tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.operators import dataset as D
from launchlake.operators import text_data as X
from launchlake.plans import kernel_queries as KQ
from launchlake.plans import launch_queries as LQ
from launchlake.plans import views
from launchlake.plans.registry import query
from launchlake.plans.views import CLASSES, SQL, sql
from launchlake.session import materialize

SEED = 1337


def r6(col):
    return F.round(col, 6)


# ---- manifests -------------------------------------------------------------

@query("scan_capture_manifest", sql("""
SELECT capture_id, CASE WHEN capture_id % 31 = 0 AND variant = 'P' THEN 'label, variant' WHEN capture_id % 31 = 0 THEN 'label' WHEN variant = 'P' THEN 'variant' END AS missing_fields FROM v7""", "v7"))
def _(spark, d):
    rows = views.captures(spark, d).withColumns({
        "label": F.when(F.col("capture_id") % 31 != 0, F.col("label")), "variant": F.when(F.col("variant") != "P", F.col("variant"))})
    return D.check_required(rows, D.MANIFEST_FIELDS).select("capture_id", "missing_fields")


@query("scan_label_manifest", sql("""
SELECT binary_name, count(*) AS copies, CASE WHEN count(*) > 1 THEN 'duplicate name' WHEN max(gone) THEN 'missing fields: opt_level' END AS reject_reason
FROM (SELECT workload || capture_id // 3 AS binary_name, capture_id % 7 = 0 AS gone FROM v7) GROUP BY ALL""", "v7"))
def _(spark, d):
    rows = views.captures(spark, d).select(
        F.concat("workload", F.floor(F.col("capture_id") / 3)).alias("binary_name"), "family", "label",
        F.when(F.col("capture_id") % 7 != 0, F.lit("O2")).alias("opt_level"))
    return D.label_manifest(rows, "binary_name").select("binary_name", "copies", "reject_reason")


@query("skip_existing_outputs", sql("SELECT capture_id FROM v7 WHERE capture_path NOT IN (SELECT capture_path FROM v7 WHERE runtime_sec = 60)", "v7"))
def _(spark, d):
    rows = views.captures(spark, d)
    return D.skip_existing(rows, rows.where(F.col("runtime_sec") == 60), "capture_path").select("capture_id")


@query("filter_empty_captures", sql("SELECT capture_id FROM v7 WHERE n_launch IS NULL OR n_launch <> 0", "v7"))
def _(spark, d):
    return D.filter_empty_captures(views.captures(spark, d)).select("capture_id")


@query("manifest_text_search", sql("""SELECT capture_id, workload, label FROM v7 WHERE contains(lower(workload || '|' || program || '|' || variant || '|' || family || '|' || label
  || '|' || CASE WHEN label = 'mining_like' THEN 'mining' ELSE 'benign' END), 'mini') OR contains(lower(workload), 'mini')""", "v7"))
def _(spark, d):
    rows = views.captures(spark, d).withColumn("binary_label", scalars.binary_label("label"))
    return D.text_search(rows, "MINI").select("capture_id", "workload", "label")


@query("filter_runs_by_condition", sql("SELECT capture_id, runtime_sec, repeat FROM v7 WHERE runtime_sec = 60 AND repeat <= 2", "v7"))
def _(spark, d):
    return D.filter_runs(views.captures(spark, d), 60, 2).select("capture_id", "runtime_sec", "repeat")


@query("safe_workload_name", sql("""
SELECT capture_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS safe, 'k_' || replace(program, ' ', '_') AS kernel_safe FROM (
  SELECT *, lower(trim(regexp_replace(CASE WHEN capture_id % 10 = 0 THEN '--!' ELSE workload END, '[^A-Za-z0-9_]+', '_', 'g'), '_')) AS s FROM v7)""", "v7"))
def _(spark, d):
    name = F.when(F.col("capture_id") % 10 == 0, "--!").otherwise(F.col("workload"))
    return views.captures(spark, d).select(
        "capture_id", scalars.safe_workload(name).alias("safe"), scalars.safe_kernel(F.concat(F.lit(".k "), "program", F.lit("-"))).alias("kernel_safe"))


@query("disambiguate_names", sql("""
SELECT capture_id, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY capture_id) = 1 THEN base ELSE base || '_' || capture_id END AS unique_workload
FROM (SELECT capture_id, lower(trim(regexp_replace(workload, '[^A-Za-z0-9_]+', '_', 'g'), '_')) AS base FROM v7)""", "v7"))
def _(spark, d):
    return D.disambiguate_names(views.captures(spark, d), "capture_id").select("capture_id", "unique_workload")


@query("group_id_from_name", sql("SELECT capture_id, program || ' ' || family AS group_id FROM v7", "v7"))
def _(spark, d):
    return views.captures(spark, d).select("capture_id", scalars.group_id("workload").alias("group_id"))


@query("split_program_variant", sql("""
SELECT capture_id, program || ' ' || family || CASE WHEN capture_id % 4 = 1 THEN '_x' ELSE '' END AS base, CASE WHEN capture_id % 4 = 1 THEN 'default' ELSE 'o' || (2 + capture_id % 2) END AS variant_name FROM v7""", "v7"))
def _(spark, d):
    rows = views.captures(spark, d)
    name = F.when(F.col("capture_id") % 4 == 1, F.concat(F.regexp_replace("workload", "_o[23]$", ""), F.lit("_x"))).otherwise(F.upper("workload"))
    name = F.when(F.col("capture_id") % 4 == 1, name).otherwise(F.concat(F.regexp_replace("workload", "_o[23]$", ""), F.substring(F.upper("workload"), -3, 3)))
    program, variant = scalars.split_variant(name)
    return rows.select("capture_id", program.alias("base"), variant.alias("variant_name"))


_FAMILIES = list(scalars.PRIMARY_LABELS)


@query("map_labels", sql(f"""
, f AS (SELECT capture_id, {views._LIST(_FAMILIES)}[capture_id % {len(_FAMILIES) + 1} + 1] AS fam FROM v7)
SELECT capture_id, fam AS family, CASE WHEN fam IN ('ai', 'hpc', 'graph', 'image_signal', 'cuda_samples') THEN 'benign_compute_like' WHEN fam IN ('crypto_benign', 'compression') THEN 'benign_crypto_hash_like'
  WHEN fam = 'memory' THEN 'benign_memory_like' WHEN fam IS NOT NULL THEN 'mining_like' END AS label,
  CASE WHEN fam IS NOT NULL AND fam NOT IN ('ai', 'hpc', 'graph', 'image_signal', 'cuda_samples', 'crypto_benign', 'compression', 'memory') THEN 'mining' ELSE 'benign' END AS binary_label FROM f""", "v7"))
def _(spark, d):
    names = F.array(*[F.lit(x) for x in _FAMILIES])
    rows = views.captures(spark, d).select("capture_id", F.get(names, (F.col("capture_id") % (len(_FAMILIES) + 1)).cast("int")).alias("family"))
    rows = rows.withColumn("label", scalars.primary_label("family"))
    return rows.withColumn("binary_label", scalars.binary_label("label"))


@query("resume_anti_join", sql("SELECT capture_id FROM v7 p WHERE NOT EXISTS (SELECT 1 FROM v7 c WHERE c.status <> 'ok' AND c.label = 'mining_like' AND c.program = p.program AND c.target_percent = p.target_percent AND c.repeat = p.repeat AND c.variant = p.variant AND c.runtime_sec = p.runtime_sec)", "v7"))
def _(spark, d):
    rows = views.captures(spark, d).withColumn("throttle_mode", F.lit("duty-cycle"))
    return D.resume_plan(rows, rows.where((F.col("status") != "ok") & (F.col("label") == "mining_like"))).select("capture_id")


@query("experiment_grid", sql("""
SELECT program, p AS target_percent, r AS repeat, program || '_o2_duty_cycle_' || p || 'pct_r' || r AS workload
FROM (SELECT DISTINCT program FROM v7), (SELECT unnest([100, 75, 50, 25, 10, 5]) AS p), (SELECT unnest([1, 2, 3]) AS r)""", "v7"))
def _(spark, d):
    programs = views.captures(spark, d).select("program").distinct()
    return D.experiment_grid(programs, [100, 75, 50, 25, 10, 5], 3, "duty-cycle", "o2", 600).select("program", "target_percent", "repeat", "workload")


@query("capture_throttle_merge", sql("""
SELECT custkey, string_agg(capture_id, ',' ORDER BY capture_id) AS capture_ids, arg_min(capture_path, capture_id) AS capture_path, CAST(coalesce(sum(n_code + n_launch), 0) AS BIGINT) AS event_count,
  CAST(sum(n_code) AS BIGINT) AS code, CAST(sum(n_launch) AS BIGINT) AS launches FROM v7 GROUP BY custkey""", "v7"))
def _(spark, d):
    out = D.merge_captures(views.captures(spark, d), ["custkey"])
    counts = F.col("event_type_counts")
    return out.select("custkey", "capture_ids", "capture_path", "event_count", counts["code"].alias("code"), counts["kernel_launch"].alias("launches"))


@query("build_report", sql("""
, r AS (SELECT *, CASE WHEN status <> 'ok' THEN 'failed' WHEN n_launch = 0 THEN 'skipped_empty' ELSE 'created' END AS result, 'O' || (2 + capture_id % 2) AS opt_level FROM v7)
SELECT 'status' AS metric, result AS key, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'label', label, count(*) FROM r WHERE result = 'created' GROUP BY ALL
UNION ALL SELECT 'opt_level', opt_level, count(*) FROM r WHERE result = 'created' GROUP BY ALL
UNION ALL SELECT 'windows', 'created', CAST(sum(coalesce(n_launch, 1)) AS BIGINT) FROM r WHERE result = 'created'""", "v7"))
def _(spark, d):
    n = F.col("event_type_counts")["kernel_launch"]
    rows = views.captures(spark, d).withColumns({
        "result": F.when(F.col("status") != "ok", "failed").when(n == 0, "skipped_empty").otherwise("created"),
        "windows": F.coalesce(n, F.lit(1)), "opt_level": F.concat(F.lit("O"), 2 + F.col("capture_id") % 2)})
    return D.build_report(rows)


SQL["man"] = """
man AS (SELECT 'c' || m AS capture_id, arg_max(program, o) AS program, arg_max(target_percent, o) AS target_percent, arg_max(label, o) AS label, arg_max(family, o) AS family,
  arg_max(variant, o) AS variant, arg_max(workload, o) AS workload, arg_max(capture_path, o) AS capture_path FROM (SELECT *, capture_id AS o, capture_id % 8 AS m FROM v7 WHERE capture_id % 8 <> 3) GROUP BY m)"""


def manifest(spark, d) -> DataFrame:
    """The last manifest row of each capture of the launch view; one is missing."""
    rows = views.captures(spark, d).where(F.col("capture_id") % 8 != 3).withColumn("ord", F.col("capture_id"))
    rows = rows.withColumn("capture_id", F.concat(F.lit("c"), F.col("ord") % 8)).select(
        "capture_id", "program", "target_percent", "label", "family", "variant", "workload", "capture_path", "ord")
    return D.last_per_key(rows, "capture_id", "ord")


def entries(spark, d) -> DataFrame:
    return manifest(spark, d).withColumns({
        "binary_label": F.lit(None).cast("string"), "opt_level": F.lit("capture"), "parent_workload": scalars.safe_workload("workload")})


@query("windows_by_capture_condition", sql("""
SELECT coalesce(program, 'unknown') || ':' || coalesce(CAST(target_percent AS VARCHAR), 'unknown') || '%' AS condition, 'dynamic' AS window_type, count(*) AS windows
FROM window_named LEFT JOIN man USING (capture_id) GROUP BY ALL""", "v1", "launch_rows", "scan", "windows", "v7", "man"))
def _(spark, d):
    return D.windows_by_condition(LQ.numbered_windows(spark, d).withColumn("window_type", F.lit("dynamic")), manifest(spark, d))


PARENT = "lower(trim(regexp_replace(workload, '[^A-Za-z0-9_]+', '_', 'g'), '_'))"


@query("window_manifest", sql(f"""
SELECT {PARENT} || '__' || w.window_id AS workload, w.capture_id, w.window_id, label, CASE WHEN label = 'mining_like' THEN 'mining' ELSE 'benign' END AS binary_label, family, program, variant,
  {PARENT} AS group_id, max_ratio, w.token_cost AS window_token_cost, capture_path AS source_capture_path,
  'int_bitwise_gate,composition_signature_new,' || CASE WHEN is_flush = 1 THEN '{D.FLUSH}' ELSE '{D.OVERFLOW}' END AS trigger_reason,
  pre_clip_token_cost, r.token_cost AS rendered_token_cost, front_clipped, text_md5
FROM window_named w JOIN man USING (capture_id) LEFT JOIN rendered r ON r.capture_id = w.capture_id AND r.window_id = w.window_id""", "v1", "launch_rows", "scan", "windows", "v7", "man", *KQ.RENDERED))
def _(spark, d):
    w = LQ.numbered_windows(spark, d).withColumn("window_token_cost", F.col("window_cost"))
    return D.window_manifest(w, entries(spark, d), KQ.rendered_windows(spark, d)).select(
        "workload", "capture_id", "window_id", "label", "binary_label", "family", "program", "variant", "group_id", "max_ratio", "window_token_cost", "source_capture_path",
        F.array_join("trigger_reason", ",").alias("trigger_reason"), "pre_clip_token_cost", "rendered_token_cost", "front_clipped", F.md5("text").alias("text_md5"))


@query("no_window_rows", sql(f"""
SELECT capture_id, {PARENT} || '__no_l0_window' AS workload, label, CASE WHEN label = 'mining_like' THEN 'mining' ELSE 'benign' END AS binary_label, {PARENT} AS group_id, 'benign' AS default_prediction
FROM man WHERE capture_id NOT IN (SELECT capture_id FROM window_named)""", "v1", "launch_rows", "scan", "windows", "v7", "man"))
def _(spark, d):
    return D.no_window_rows(entries(spark, d), LQ.numbered_windows(spark, d)).select(
        "capture_id", "workload", "label", "binary_label", "group_id", "default_prediction")


# ---- splits ----------------------------------------------------------------

SQL["split"] = f"""
grp AS (SELECT group_id, any_value(label) AS label, md5('{SEED}:' || group_id) AS h FROM v5 GROUP BY group_id),
cnt AS (SELECT label, count(*) AS n, CAST(floor(count(*) * 0.70::DOUBLE) AS BIGINT) AS b0, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS b1 FROM grp GROUP BY label),
frac AS (SELECT *, n - b0 - b1 - b1 AS rest, n * 0.70::DOUBLE - b0 AS f0, n * 0.15::DOUBLE - b1 AS f1 FROM cnt),
cuts AS (SELECT label, n, b0 + (CASE WHEN f0 >= f1 THEN rest >= 1 ELSE rest >= 3 END)::INT AS n_train,
  b1 + (CASE WHEN f0 >= f1 THEN rest >= 2 ELSE rest >= 1 END)::INT AS n_val FROM frac),
placed AS (SELECT g.group_id, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_val THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, group_id) AS r FROM grp) g JOIN cuts USING (label)),
sp AS (SELECT v5.*, split FROM v5 JOIN placed USING (group_id))"""


def split_examples(spark, d) -> DataFrame:
    return D.grouped_stratified_split(views.examples(spark, d), SEED)


@query("grouped_stratified_split", sql("SELECT workload, group_id, label, split FROM sp", "v5", "split"))
def _(spark, d):
    return split_examples(spark, d).select("workload", "group_id", "label", "split")


@query("grouped_split_simple", sql(f"""
, g AS (SELECT group_id, row_number() OVER (ORDER BY md5('{SEED}:' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM v5))
SELECT workload, group_id, CASE WHEN r <= greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.7::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM v5 JOIN g USING (group_id)""", "v5"))
def _(spark, d):
    return D.grouped_split_simple(views.examples(spark, d), SEED).select("workload", "group_id", "split")


@query("all_test_split", sql("SELECT workload, 'test' AS split FROM v5", "v5"))
def _(spark, d):
    return D.all_test_split(views.examples(spark, d)).select("workload", "split")


@query("sorted_group_listing", sql("SELECT group_id, workload, family FROM v5 ORDER BY group_id, workload", "v5"))
def _(spark, d):
    return views.examples(spark, d).select("group_id", "workload", "family").orderBy("group_id", "workload")


@query("split_summary", sql("""
SELECT split, 'examples' AS metric, '' AS key, count(*) AS n FROM sp GROUP BY ALL UNION ALL SELECT split, 'groups', '', count(DISTINCT group_id) FROM sp GROUP BY ALL
UNION ALL SELECT split, 'label', label, count(*) FROM sp GROUP BY ALL UNION ALL SELECT split, 'binary_label', binary_label, count(*) FROM sp GROUP BY ALL
UNION ALL SELECT split, 'family', family, count(*) FROM sp GROUP BY ALL UNION ALL SELECT split, 'opt_level', opt_level, count(*) FROM sp GROUP BY ALL""", "v5", "split"))
def _(spark, d):
    return D.split_summary(split_examples(spark, d))


@query("split_leakage_check", sql("""
, leaky AS (SELECT workload, group_id, label, opt_level, CASE WHEN workload % 10 < 7 THEN 'train' ELSE 'val' END AS split FROM v5 WHERE family <> 'de')
SELECT 'error' AS severity, 'group_in_several_splits' AS rule, CAST(group_id AS VARCHAR) AS subject FROM leaky GROUP BY group_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'error', 'workload_missing', CAST(workload AS VARCHAR) FROM v5 WHERE workload NOT IN (SELECT workload FROM leaky)
UNION ALL SELECT 'warning', 'label_missing', s || ':' || label FROM (SELECT DISTINCT label FROM v5), (SELECT unnest(['train', 'val', 'test']) AS s) WHERE (label, s) NOT IN (SELECT label, split FROM leaky)
UNION ALL SELECT 'warning', 'opt_level_imbalance', split FROM leaky GROUP BY split HAVING abs(count(*) FILTER (opt_level = 'O2') - count(*) FILTER (opt_level = 'O3')) > 2
UNION ALL SELECT 'warning', 'small_class', label FROM v5 GROUP BY label HAVING count(*) < 20""", "v5"))
def _(spark, d):
    rows = views.examples(spark, d)
    leaky = rows.where(F.col("family") != "de").withColumn("split", F.when(F.col("workload") % 10 < 7, "train").otherwise("val"))
    return D.split_leakage_check(leaky, rows)


@query("coverage_equality", sql("SELECT workload, 'all_only' AS side FROM v5 WHERE family = 'de'", "v5"))
def _(spark, d):
    rows = views.examples(spark, d)
    return D.coverage_equality(split_examples(spark, d).where(F.col("family") != "de"), rows)


@query("union_splits", sql("SELECT split, workload, label FROM sp", "v5", "split"))
def _(spark, d):
    rows = materialize(split_examples(spark, d), "split")
    parts = {s: rows.where(F.col("split") == s).drop("split") for s in D.SPLITS}
    return D.union_splits(parts).select("split", "workload", "label")


@query("class_weights", sql("""
, g AS (SELECT group_id, min(label_id) AS label_id FROM v5 GROUP BY ALL)
SELECT label_id, count(*) AS groups, 0 AS conflicts, round((SELECT count(*) FROM g) / (4 * count(*)), 6) AS weight FROM g GROUP BY label_id""", "v5"))
def _(spark, d):
    return D.class_weights(views.examples(spark, d), 4).withColumn("weight", r6("weight"))


@query("scan_split_manifest", sql("""
SELECT workload, split, CASE WHEN family <> 'fr' THEN label_id END AS label_id, CASE WHEN family = 'fr' THEN 'unknown label: odd' END AS reject_reason FROM sp""", "v5", "split"))
def _(spark, d):
    rows = split_examples(spark, d).withColumn("label", F.when(F.col("family") == "fr", "odd").otherwise(F.col("label"))).drop("label_id")
    return D.map_known_labels(rows, {c: i for i, c in enumerate(CLASSES)}).select("workload", "split", "label_id", "reject_reason")


# ---- vocabulary ------------------------------------------------------------

SQL["tok"] = """
tok AS (SELECT split, unnest(list_filter(regexp_split_to_array(replace(text, ',', ' , '), '[ \\t\\r\\n]+'), lambda w: w <> '')) AS token FROM documents JOIN sp ON sp.workload = doc_id),
voc AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 4 AS token_id FROM (SELECT token, count(*) AS n FROM tok WHERE split = 'train' GROUP BY token)),
vocab AS (SELECT * FROM voc UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']), 0, unnest([0, 1, 2, 3, 4])),
known AS (SELECT split, t.token, count(*) AS n, any_value(v.token_id) AS token_id FROM tok t LEFT JOIN vocab v USING (token) GROUP BY ALL)"""


def split_documents(spark, d) -> DataFrame:
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("workload"), "text")
    return docs.join(split_examples(spark, d).select("workload", "split"), "workload")


def vocab(spark, d) -> DataFrame:
    return X.vocab_build(split_documents(spark, d).where(F.col("split") == "train"), 1)


@query("vocab_build", sql("SELECT token, n, token_id FROM vocab", "v5", "split", "tok"))
def _(spark, d):
    return vocab(spark, d)


@query("unk_rate", sql("""
SELECT split, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (token_id IS NULL), 0) AS BIGINT) AS unknown_tokens, round(coalesce(sum(n) FILTER (token_id IS NULL), 0) / sum(n), 6) AS unknown_rate
FROM known GROUP BY split""", "v5", "split", "tok"))
def _(spark, d):
    return X.unknown_rate(split_documents(spark, d), vocab(spark, d)).withColumn("unknown_rate", r6("unknown_rate"))


@query("top_unknown_tokens", sql("""
SELECT split, token, n, rank FROM (SELECT split, token, n, row_number() OVER (PARTITION BY split ORDER BY n DESC, token) AS rank FROM known WHERE token_id IS NULL) WHERE rank <= 25""", "v5", "split", "tok"))
def _(spark, d):
    return X.top_unknown(split_documents(spark, d), vocab(spark, d)).withColumn("rank", F.col("rank").cast("long"))
