"""Manifests, leakage-free splits, class weights, incremental builds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlake.functions import scalars
from launchlake.operators import ordered

SPLITS = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)
# Fields every capture manifest row must have.
MANIFEST_FIELDS = ["label", "family", "workload", "program", "variant", "capture_path"]
LABEL_FIELDS = ["family", "label", "opt_level"]


def check_required(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``missing_fields``, null when the row is complete."""
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]))
    return rows.withColumn("missing_fields", F.when(F.size(gone) > 0, F.array_join(gone, ", ")))


def label_manifest(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per binary with the reason it is unusable, if any.

    Of repeated names the first known value by ``order`` stands, or the
    smallest field values where no order is given.
    """
    order = [*order, *LABEL_FIELDS]
    checked = check_required(rows, LABEL_FIELDS)
    counts = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.max("missing_fields").alias("missing_fields"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in LABEL_FIELDS])
    reason = F.when(F.col("copies") > 1, "duplicate name").when(
        F.col("missing_fields").isNotNull(), F.concat(F.lit("missing fields: "), "missing_fields"))
    return counts.withColumn("reject_reason", reason)


def filter_empty_captures(captures: DataFrame) -> DataFrame:
    """Drop captures known to hold no launch; unknown counts are kept."""
    counts = F.col("event_type_counts")
    launches = F.coalesce(F.try_element_at(counts, F.lit("kernel_launch")), F.lit(0))
    return captures.where(counts.isNull() | (launches != 0))


def text_search(rows: DataFrame, needle: str, columns: Sequence[str] = (
        "workload", "program", "variant", "family", "label", "binary_label")) -> DataFrame:
    """Case-insensitive substring over the manifest columns."""
    if not needle:
        return rows
    hits = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.lower())), F.lit(False)) for c in columns if c in rows.columns]
    return rows.where(reduce(lambda a, b: a | b, hits))


def filter_runs(rows: DataFrame, runtime_sec: int | None = None, repeats: int | None = None) -> DataFrame:
    if runtime_sec is not None:
        rows = rows.where(F.coalesce("runtime_sec", F.lit(-1)) == runtime_sec)
    if repeats is not None:
        rows = rows.where(F.coalesce("repeat", F.lit(-1)) <= repeats)
    return rows


def disambiguate_names(rows: DataFrame, order: str, capture: str = "capture_id", width: int = ordered.DEFAULT_WIDTH) -> DataFrame:
    """Second and later uses of a name get the capture id appended."""
    named = rows.withColumn("base", scalars.safe_workload("workload"))
    named = ordered.ordinal(named, ["base"], [order], [ordered.bucket_of(order, width)], "_use")
    suffix = F.substring(scalars.safe_workload(F.col(capture).cast("string")), 1, 12)
    unique = F.when(F.col("_use") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", suffix))
    return named.withColumn("unique_workload", unique).drop("_use")


def skip_existing(planned: DataFrame, existing: DataFrame, key: str = "workload", overwrite: bool = False) -> DataFrame:
    return planned if overwrite else planned.join(existing.select(key).distinct(), key, "left_anti")


# What identifies a planned run.
RUN_KEY = ["throttle_mode", "program", "target_percent", "repeat", "variant", "runtime_sec"]


def resume_plan(planned: DataFrame, completed: DataFrame) -> DataFrame:
    return planned.join(completed.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti")


def experiment_grid(programs: DataFrame, percents: Sequence[int], repeats: int, mode: str, variant: str, runtime_sec: int) -> DataFrame:
    """Every program with every percent and repeat, and the run's name."""
    rows = programs.withColumn("target_percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn(
        "repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    name = F.concat_ws("_", "program", F.lit(variant), F.lit(mode.replace("-", "_")),
                       F.concat("target_percent", F.lit("pct")), F.concat(F.lit("r"), "repeat"))
    return rows.withColumns({"throttle_mode": F.lit(mode), "variant": F.lit(variant), "runtime_sec": F.lit(runtime_sec), "workload": name})


def merge_captures(captures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several captures of one run as one row; counts added, ids joined in order."""
    base = captures.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(F.col("capture_id"))).cast("array<string>"), ",").alias("capture_ids"),
        F.min_by("capture_path", "capture_id").alias("capture_path"))
    counts = captures.select(*keys, F.explode("event_type_counts").alias("type", "n")).groupBy(*keys, "type").agg(F.sum("n").alias("n"))
    merged = counts.groupBy(*keys).agg(F.sum("n").alias("event_count"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("_c"))
    merged = merged.withColumn("event_type_counts", F.map_from_entries("_c")).drop("_c")
    return base.join(merged, list(keys), "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def build_report(results: DataFrame) -> DataFrame:
    """(metric, key, n) counts of a dataset build; failures stay rows."""
    created = F.col("result") == "created"
    parts = [
        results.groupBy(F.lit("status").alias("metric"), F.col("result").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        results.where(created).groupBy(F.lit("label").alias("metric"), F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        results.where(created).groupBy(F.lit("opt_level").alias("metric"), F.col("opt_level").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        results.where(created).agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).select(
            F.lit("windows").alias("metric"), F.lit("created").alias("key"), "n")]
    return reduce(lambda a, b: a.unionByName(b), parts)


# Why a window was emitted; the gate, the signature, and what closed the queue.
GATE_ON, GATE_OFF, NEW_SIGNATURE = "int_bitwise_gate", "int_bitwise_gate_disabled", "composition_signature_new"
OVERFLOW, FLUSH = "token_budget_overflow", "offline_final_flush"


def window_manifest(windows: DataFrame, captures: DataFrame, rendered: DataFrame | None = None, use_gate: bool = True) -> DataFrame:
    """Flat example row per window with the metadata of its capture and, if given, its rendered text and costs.

    ``rendered`` has one row per (capture_id, window_id): ``pre_clip_token_cost``, ``token_cost``, ``front_clipped`` and ``text``.
    A window without a rendered row keeps nulls there.
    """
    binary = F.coalesce(F.col("binary_label"), scalars.binary_label("label"))
    rows = windows.join(captures, "capture_id")
    reason = F.array(F.lit(GATE_ON if use_gate else GATE_OFF), F.lit(NEW_SIGNATURE), F.when(F.col("is_flush"), FLUSH).otherwise(OVERFLOW))
    rows = rows.select(
        F.concat_ws("__", "parent_workload", "window_id").alias("workload"), F.concat(F.lit("windows/"), "window_id", F.lit(".listing")).alias("path"),
        "label", binary.alias("binary_label"), "family", "opt_level", "program", "variant", "capture_id", "parent_workload", "window_id",
        F.lit("dynamic").alias("window_type"), F.lit("stream").alias("l0_group_kind"), F.to_json(F.struct("pid", "device_pci_bus_id", "stream")).alias("l0_group_key"),
        F.col("parent_workload").alias("group_id"), F.col("capture_path").alias("source_capture_path"), reason.alias("trigger_reason"),
        "max_ratio", "window_token_cost", F.lit("rolling_token_window").alias("packing_mode"))
    if rendered is None:
        return rows
    return rows.join(rendered.select("capture_id", "window_id", "pre_clip_token_cost", F.col("token_cost").alias("rendered_token_cost"), "front_clipped", "text"), ["capture_id", "window_id"], "left")


def no_window_rows(captures: DataFrame, windows: DataFrame) -> DataFrame:
    """Placeholder example, benign by default, per capture without windows."""
    bare = captures.join(windows.select("capture_id").distinct(), "capture_id", "left_anti")
    return bare.select(
        "capture_id", scalars.safe_workload(F.concat("parent_workload", F.lit("__no_l0_window"))).alias("workload"),
        F.lit("windows/no_l0_window.listing").alias("path"), "label", F.coalesce(F.col("binary_label"), scalars.binary_label("label")).alias("binary_label"),
        "family", "opt_level", "parent_workload", F.lit("no_l0_window").alias("window_id"), F.lit("no_l0_window").alias("window_type"),
        F.col("parent_workload").alias("group_id"), F.lit("none").alias("packing_mode"), F.lit(0).cast("long").alias("window_token_cost"),
        F.lit(True).alias("no_l0_window"), F.lit("benign").alias("default_prediction"), F.lit("no_l0_window_emitted").alias("default_prediction_reason"))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The later row wins; one map-side-combined aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def windows_by_condition(windows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Window counts per ``program:percent%`` condition, missing ones unknown."""
    joined = windows.join(manifest.select("capture_id", "program", "target_percent"), "capture_id", "left")
    condition = F.concat(F.coalesce("program", F.lit("unknown")), F.lit(":"), F.coalesce(F.col("target_percent").cast("string"), F.lit("unknown")), F.lit("%"))
    return joined.groupBy(condition.alias("condition"), "window_type").agg(F.count(F.lit(1)).alias("windows"))


# ---- splits ----------------------------------------------------------------

def split_counts(groups: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Add the number of groups each split takes from ``n`` groups.

    Largest remainders first (larger ratio, then split order on ties), then a
    split that got none takes one from the largest.
    """
    if len(ratios) != len(SPLITS) or abs(sum(ratios) - 1) > 1e-6 or min(ratios) <= 0:
        raise ValueError("ratios must be positive and sum to one")
    names, n = [f"n_{s}" for s in SPLITS], F.col("n")
    rows = groups.withColumns({f"_b{i}": F.floor(n * r).cast("long") for i, r in enumerate(ratios)})
    rows = rows.withColumns({f"_f{i}": n * r - F.col(f"_b{i}") for i, r in enumerate(ratios)})
    rest = n - sum((F.col(f"_b{i}") for i in range(3)), F.lit(0))

    def ahead(j: int, i: int) -> Column:
        tie = ratios[j] > ratios[i] or (ratios[j] == ratios[i] and j < i)
        first = F.col(f"_f{j}") > F.col(f"_f{i}")
        return ((first | (F.col(f"_f{j}") == F.col(f"_f{i}"))) if tie else first).cast("int")

    rank = lambda i: sum((ahead(j, i) for j in range(3) if j != i), F.lit(0))
    rows = rows.withColumns({names[i]: F.col(f"_b{i}") + (rank(i) < rest).cast("int") for i in range(3)})
    for i in range(3):
        top = F.greatest(*names)
        gives = (n >= 3) & (F.col(names[i]) == 0) & (top > 1)
        donor = F.when(F.col(names[0]) == top, 0).when(F.col(names[1]) == top, 1).otherwise(2)
        rows = rows.withColumns({"_g": gives, "_d": donor})
        rows = rows.withColumns({names[j]: F.col(names[j]) + F.when(F.col("_g") & (j == i), 1).otherwise(0)
                                 - F.when(F.col("_g") & (F.col("_d") == j), 1).otherwise(0) for j in range(3)})
    return rows.drop("_g", "_d", *[f"_{c}{i}" for c in "bf" for i in range(3)])


def _shuffled(groups: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Seeded order of groups: by digest, positions from a bucketed scan."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")))
    rows = groups.withColumn("_h", digest)
    bucket = [F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")]
    return ordered.ordinal(rows, keys, ["_h", "group_id"], bucket, "_at").drop("_h")


def _assign(rows: DataFrame) -> DataFrame:
    at = F.col("_at")
    split = F.when(at < F.col("n_train"), "train").when(at < F.col("n_train") + F.col("n_val"), "val").otherwise("test")
    return rows.withColumn("split", split)


def group_labels(examples: DataFrame) -> DataFrame:
    """One row per group with its label and whether its labels disagree."""
    return examples.groupBy("group_id").agg(
        F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("mixed"), F.count(F.lit(1)).alias("records"))


def grouped_stratified_split(examples: DataFrame, seed: int = 1337, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Add ``split``: whole groups, stratified by label, no split left empty."""
    groups = group_labels(examples)
    groups = groups.withColumn("label", F.when(F.col("mixed"), F.raise_error(F.concat(
        F.lit("group has several labels: "), F.col("group_id").cast("string")))).otherwise(F.col("label")))
    sizes = split_counts(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), ratios)
    placed = _assign(_shuffled(groups.select("group_id", "label"), ["label"], seed).join(sizes, "label"))
    return examples.join(placed.select("group_id", "split"), "group_id")


def grouped_split_simple(examples: DataFrame, seed: int = 1337) -> DataFrame:
    """Unstratified grouped split: 70 %, 15 %, rest, at least one each."""
    groups = examples.select("group_id").distinct()
    n = groups.agg(F.count(F.lit(1)).alias("n")).select(
        F.greatest(F.lit(1), F.floor(F.col("n") * 0.70)).cast("long").alias("n_train"),
        F.greatest(F.lit(1), F.floor(F.col("n") * 0.15)).cast("long").alias("n_val"))
    placed = _shuffled(groups, [], seed).crossJoin(F.broadcast(n))  # one row
    return examples.join(_assign(placed).select("group_id", "split"), "group_id")


def all_test_split(examples: DataFrame) -> DataFrame:
    return examples.withColumn("split", F.lit("test"))


def split_summary(examples: DataFrame, columns: Sequence[str] = ("label", "binary_label", "family", "opt_level")) -> DataFrame:
    """(split, metric, key, n): examples, distinct groups, and counts per column.

    One grouping-sets pass for the counts; groups are de-duplicated first.
    """
    named = F.explode(F.array(
        F.struct(F.lit("examples").alias("metric"), F.lit("").alias("key")),
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("key")) for c in columns])).alias("m")
    counts = examples.select("split", named).groupBy("split", "m").agg(F.count(F.lit(1)).alias("n")).select("split", "m.*", "n")
    groups = examples.select("split", "group_id").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(groups.select("split", F.lit("groups").alias("metric"), F.lit("").alias("key"), "n"))


def split_leakage_check(examples: DataFrame, everything: DataFrame) -> DataFrame:
    """(severity, rule, subject) rows for broken or doubtful splits."""
    twice = examples.groupBy("workload").agg(F.count(F.lit(1)).alias("c"), F.min("split").alias("a"), F.max("split").alias("b"))
    parts = [
        twice.where(F.col("c") > 1).select(F.lit("error").alias("severity"), F.lit("workload_repeated").alias("rule"), F.col("workload").cast("string").alias("subject")),
        examples.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where(F.col("a") != F.col("b")).select(
            F.lit("error"), F.lit("group_in_several_splits"), F.col("group_id").cast("string")),
        everything.select("workload").join(examples.select("workload"), "workload", "left_anti").select(
            F.lit("error"), F.lit("workload_missing"), F.col("workload").cast("string"))]
    labels = everything.select("label").distinct()
    per = labels.withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    parts.append(per.join(examples.select("label", "split").distinct(), ["label", "split"], "left_anti").select(
        F.lit("warning"), F.lit("label_missing"), F.concat_ws(":", "split", "label")))
    opts = examples.groupBy("split").agg((F.count_if(F.col("opt_level") == "O2") - F.count_if(F.col("opt_level") == "O3")).alias("d"))
    parts.append(opts.where(F.abs("d") > 2).select(F.lit("warning"), F.lit("opt_level_imbalance"), F.col("split")))
    small = everything.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 20)
    parts.append(small.select(F.lit("warning"), F.lit("small_class"), F.col("label")))
    return reduce(lambda a, b: a.union(b), parts)


def coverage_equality(examples: DataFrame, everything: DataFrame) -> DataFrame:
    """Workloads on one side only, tagged with the side; empty when covered."""
    left, right = examples.select("workload").distinct(), everything.select("workload").distinct()
    return left.exceptAll(right).withColumn("side", F.lit("splits_only")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("all_only")))


def windowed_only(examples: DataFrame) -> DataFrame:
    """Examples without the placeholders of captures that have no window (``no_window``, where the column exists)."""
    return examples.where(~F.coalesce("no_window", F.lit(False))) if "no_window" in examples.columns else examples


def class_weights(examples: DataFrame, n_labels: int, strict: bool = True) -> DataFrame:
    """Balanced weights over groups with windows.

    A group with several labels, or a class without groups, stops a strict
    run; otherwise they are counted in ``conflicts`` and get no weight.
    """
    groups = windowed_only(examples).groupBy("group_id").agg(F.min("label_id").alias("label_id"), F.max("label_id").alias("_hi"))
    if strict:
        mixed = F.raise_error(F.concat(F.lit("conflicting labels for group "), F.col("group_id").cast("string"))).cast("boolean")
        groups = groups.where(F.when(F.col("_hi") != F.col("label_id"), mixed).otherwise(True))
    per = groups.groupBy("label_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_hi") != F.col("label_id")).alias("conflicts"))
    total = per.agg(F.sum("groups").alias("total")).withColumn("label_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_labels - 1).cast("long"))))
    out = total.join(per, "label_id", "left")
    if strict:
        absent = F.raise_error(F.concat(F.lit("no group has label "), F.col("label_id").cast("string"))).cast("boolean")
        out = out.where(F.when(F.col("groups").isNull(), absent).otherwise(True))
    return out.select("label_id", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"),
                      (F.col("total") / (n_labels * F.col("groups"))).alias("weight"))


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    frames = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def map_known_labels(rows: DataFrame, label2id: dict[str, int], column: str = "label") -> DataFrame:
    """Add ``label_id`` and a reason for labels outside the map."""
    pairs = F.create_map(*[F.lit(x) for kv in label2id.items() for x in kv])
    ids = F.try_element_at(pairs, F.col(column)).cast("long")
    return rows.withColumns({"label_id": ids, "reject_reason": F.when(ids.isNull(), F.concat(F.lit("unknown label: "), F.coalesce(column, F.lit("None"))))})
