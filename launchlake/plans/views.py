"""Derived inputs: how the driver tables stand in for launch telemetry.

Each view exists twice, as a Spark DataFrame and as a DuckDB CTE, so a query
and its check start from the same rows. All views read their whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.operators import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# launches: one row per telemetry event, from the events table

def launch_columns(events: DataFrame) -> DataFrame:
    kind_len = F.length("event_type")
    pick = F.col("event_id") % 50
    return events.select(
        F.col("event_id").alias("sequence"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        (F.col("user_id") % 30).alias("pid"),
        F.concat(F.lit("s"), F.col("user_id") % 30 % 10).alias("session_id"),
        F.concat(F.lit("d"), F.col("user_id") % 30 % 4).alias("device_pci_bus_id"),
        (F.col("event_id") % 2).alias("stream"),
        (F.col("event_id") % 3).alias("tid"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(pick == 0, "code").when(pick == 1, "stats").otherwise("kernel_launch").alias("type"),
        F.col("event_type").alias("kernel_name"),
        (kind_len % 3).cast("long").alias("code_id"),
        F.col("value").alias("value"),
        F.concat(F.lit("c"), F.col("user_id") % 30 % 5).alias("capture_id"),
    ).select(
        "*",
        F.when(F.col("k") % 11 != 0, F.concat_ws(":", "code_id", "kernel_name")).alias("l0_kernel_id"),
        (F.floor("value") + 1).cast("long").alias("l0_token_cost"),
        ((F.length("kernel_name") * 11 % 100) / 100).alias("l0_bitwise_integer_ratio"),
        F.array((1 + F.col("k") % 4).cast("int"), F.lit(1), F.lit(1)).alias("grid_dim"),
        F.array((32 * (1 + F.col("k") % 3)).cast("int"), F.lit(1), F.lit(1)).alias("block_dim"),
        (F.col("k") * 16).alias("shared_mem_bytes"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return launch_columns(table(spark, sf_dir, "events"))


# Fixed values of the launch view used by the window queries.
VIEW_BUDGET = 60
VIEW_THRESHOLD = 0.65

SQL: dict[str, str] = {}

SQL["v1"] = """
v1 AS (
  SELECT a.*,
    CASE WHEN k % 11 <> 0 THEN code_id || ':' || kernel_name END AS l0_kernel_id,
    CAST(floor(value) AS BIGINT) + 1 AS l0_token_cost,
    ((length(kernel_name) * 11) % 100) / 100.0::DOUBLE AS ratio,
    (1 + k % 4) || 'x1x1' AS grid_key, (32 * (1 + k % 3)) || 'x1x1' AS block_key
  FROM (
    SELECT event_id AS sequence, epoch_us(ts) * 1000 AS timestamp_ns, user_id % 30 AS pid,
      's' || (user_id % 30 % 10) AS session_id, 'd' || (user_id % 30 % 4) AS device,
      event_id % 2 AS stream, event_id % 3 AS tid,
      CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      CASE WHEN event_id % 50 = 0 THEN 'code' WHEN event_id % 50 = 1 THEN 'stats' ELSE 'kernel_launch' END AS type,
      event_type AS kernel_name, CAST(length(event_type) % 3 AS BIGINT) AS code_id, value,
      'c' || (user_id % 30 % 5) AS capture_id
    FROM events) a)"""

SQL["launch_rows"] = "launch_rows AS (SELECT * FROM v1 WHERE type = 'kernel_launch')"

# ready launches with their running cost per stream
SQL["scan"] = """
scan AS (
  SELECT *, idx + 1 AS upto, p - cost AS e FROM (
    SELECT *, l0_token_cost AS cost, l0_kernel_id AS kid,
      row_number() OVER s - 1 AS idx, CAST(sum(l0_token_cost) OVER s AS BIGINT) AS p
    FROM launch_rows WHERE l0_kernel_id IS NOT NULL
    WINDOW s AS (PARTITION BY capture_id, pid, device, stream ORDER BY sequence)))"""

SQL["windows"] = f"""
ends AS (
  SELECT capture_id, pid, device, stream, sequence, idx, e, p, 0 AS is_flush FROM scan
  UNION ALL
  SELECT capture_id, pid, device, stream, max(sequence) + 1, max(idx) + 1, max(p), max(p), 1
  FROM scan GROUP BY ALL),
queue AS (
  SELECT c.capture_id, c.pid, c.device, c.stream, c.sequence AS trigger_seq, c.idx AS end_idx, c.is_flush,
    m.kid, m.ratio, m.cost, m.idx, m.e, c.p AS cp
  FROM ends c JOIN scan m ON c.capture_id = m.capture_id AND c.pid = m.pid AND c.device = m.device
    AND c.stream = m.stream AND m.e BETWEEN c.e - {VIEW_BUDGET} AND c.e AND m.idx <= c.idx),
per_kernel AS (
  SELECT capture_id, pid, device, stream, trigger_seq, end_idx, is_flush, kid, count(*) AS n,
    arg_max(ratio, idx) AS r, sum(cost) AS c, min(idx) AS i0, min(e) AS e0, max(cp) AS cp
  FROM queue GROUP BY ALL),
signed AS (
  SELECT capture_id, pid, device, stream, trigger_seq, end_idx, is_flush,
    string_agg(kid, ',' ORDER BY kid) AS kernel_set,
    array_to_string(list_slice(list(kid ORDER BY n DESC, kid), 1, 3), ',') AS top3,
    max(r) AS max_ratio, CAST(sum(c) AS BIGINT) AS token_cost, CAST(sum(n) AS BIGINT) AS launch_count,
    count(*) AS distinct_kernel_count, min(i0) AS start_idx
  FROM per_kernel GROUP BY ALL),
passing AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, pid, device, stream, kernel_set, top3
                               ORDER BY is_flush, end_idx) AS nth
  FROM signed WHERE (is_flush = 1 OR token_cost > {VIEW_BUDGET}) AND max_ratio >= {VIEW_THRESHOLD}),
first_seen AS (
  SELECT capture_id, pid, device, stream, min(sequence) AS first_seq FROM launch_rows GROUP BY ALL),
windows AS (
  SELECT w.* EXCLUDE (nth), first_seq,
    row_number() OVER (PARTITION BY w.capture_id
      ORDER BY is_flush, CASE WHEN is_flush = 1 THEN first_seq ELSE trigger_seq END) - 1 AS window_index
  FROM passing w JOIN first_seen USING (capture_id, pid, device, stream) WHERE nth = 1),
window_named AS (
  SELECT *, 'w' || lpad(CAST(window_index AS VARCHAR), CAST(greatest(4, length(CAST(window_index AS VARCHAR))) AS INTEGER), '0')
    || '_dynamic_stream' AS window_id FROM windows)"""

SQL["members"] = """
members AS (
  SELECT w.capture_id, w.window_id, m.idx - w.start_idx AS pos, m.sequence, m.timestamp_ns, m.code_id,
    m.kernel_name, m.kid, m.cost, m.ratio, m.grid_key, m.block_key
  FROM window_named w JOIN scan m ON w.capture_id = m.capture_id AND w.pid = m.pid AND w.device = m.device
    AND w.stream = m.stream AND m.idx >= w.start_idx AND (m.idx <= w.end_idx))"""

# --------------------------------------------------------------------------
# listing: one instruction per word of a document

# Fixed values of the listing view: mnemonic and operand pattern by number.
VIEW_OPS = [
    ("IADD3", "alu"), ("IMAD.WIDE", "alu"), ("LOP3.LUT", "alu"), ("SHF.R.U32", "alu"), ("POPC", "alu"),
    ("PRMT", "alu"), ("LDG.E", "mem"), ("STG.E", "mem"), ("LDS", "mem"), ("ATOM", "mem"), ("FADD", "alu"),
    ("FFMA", "alu"), ("MUFU.RCP", "alu"), ("ISETP.GE", "pred"), ("MOV", "const"), ("BRA", "bra"),
    ("BRA", "bra"), ("HMMA", "alu"), ("NOP", "none"), ("EXIT", "none"), ("CALL.REL", "call"),
    ("S2R", "sreg"), ("SEL", "alu"), ("LEA", "alu"),
]
OP_COUNT = len(VIEW_OPS)


def _words(text: str) -> Column:
    return F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != "")


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kernel per document with its words."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("kernel_id"), "source", "lang", _words("text").alias("words"))


def raw_instructions(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """(kernel_id, idx, addr, text) rows with unresolved branch addresses.

    With ``spread``, documents are spread by ``kernel_id`` while they are still compact text,
    so the per-kernel scans further down need no shuffle of the far larger
    instruction table.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("kernel_id"), "text")
    # a fixed count: adaptive coalescing would judge by the compact text, not by what it turns into
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # without order within kernels the compact text is dealt in turn, so few or uneven splits make no large task
    docs = docs.repartition(parts, "kernel_id") if spread else docs.repartition(parts)
    # the count is taken below the generator, which then carries no array along
    docs = docs.select("kernel_id", _words("text").alias("words")).withColumn("n", F.size("words"))
    # outer: for an inner one the optimizer would filter by the size of the array, and cut every text three times
    rows = docs.select("kernel_id", "n", F.posexplode_outer("words").alias("idx", "word")).where("idx is not null")
    size, idx = F.length("word"), F.col("idx")
    number = (size * 3 + F.ascii("word") + idx) % OP_COUNT
    names = F.array(*[F.lit(o) for o, _ in VIEW_OPS])
    kinds = F.array(*[F.lit(k) for _, k in VIEW_OPS])
    rows = rows.select("kernel_id", "idx", "n", size.alias("size"), number.alias("number"))
    rows = rows.select("*", names[F.col("number")].alias("op"), kinds[F.col("number")].alias("kind"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    size, target = F.col("size") % 32, (idx.cast("long") * 7 % F.col("n")) * 16
    operands = (
        F.when(F.col("kind") == "alu", text(" R", size, ", R", idx % 8, ", 0x", F.lower(F.hex(idx % 256)), ", RZ"))
        .when(F.col("kind") == "mem", text(" R", size, ", [R", idx % 8, "+0x10]"))
        .when(F.col("kind") == "pred", F.lit(" P0, PT, R1, R2, PT"))
        .when(F.col("kind") == "const", F.lit(" R1, c[0x0][0x20]"))
        .when(F.col("kind") == "bra", text(" 0x", _hex8(target)))
        .when(F.col("kind") == "call", F.lit(" `(.helper)"))
        .when(F.col("kind") == "sreg", F.lit(" R8, SR_TID.X"))
        .otherwise(F.lit(""))
    )
    guard = F.when(idx % 5 == 0, F.lit("@P0 ")).when(idx % 11 == 3, F.lit("@!P1 ")).otherwise(F.lit(""))
    return rows.select(
        "kernel_id", "idx", _hex8(idx.cast("long") * 16).alias("addr"), text(guard, F.col("op"), operands).alias("text")
    )


def _hex8(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 8, "0")


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

SQL["ins0"] = f"""
ins0 AS (
  SELECT *, {_LIST(o for o, _ in VIEW_OPS)}[number + 1] AS op, {_LIST(k for _, k in VIEW_OPS)}[number + 1] AS kind,
    CASE WHEN idx % 5 = 0 THEN '@PRED ' WHEN idx % 11 = 3 THEN '@!PRED ' ELSE '' END AS guard
  FROM (
    SELECT kernel_id, n, idx, length(word) AS size, (length(word) * 3 + unicode(word) + idx) % {OP_COUNT} AS number
    FROM (
      SELECT kernel_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS idx
      FROM (SELECT doc_id AS kernel_id,
              list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS words FROM documents))))"""

# op: bare upper-case mnemonic; target: index a branch goes to; labelled: index is a branch target
SQL["ins"] = """
ins AS (
  SELECT i.kernel_id, i.n, i.idx, i.size, split_part(i.op, '.', 1) AS op, i.op AS full_op, i.kind, i.guard,
    i.guard <> '' AS predicated,
    CASE WHEN i.kind = 'bra' THEN (i.idx * 7) % i.n END AS target, t.idx IS NOT NULL AS labelled
  FROM ins0 i LEFT JOIN (SELECT DISTINCT kernel_id, (idx * 7) % n AS idx FROM ins0 WHERE kind = 'bra') t
    ON t.kernel_id = i.kernel_id AND t.idx = i.idx)"""

# text after normalisation (null for dropped lines) and the quirky opcode read back from it
SQL["norm"] = """
norm AS (
  SELECT *, CASE WHEN body IS NULL THEN NULL ELSE guard || body END AS norm_text,
    CASE WHEN body IS NULL THEN NULL
         WHEN guard <> '' THEN regexp_replace(trim(guard), '^[@!PT0-9]+', '')
         ELSE regexp_replace(op, '^[@!PT0-9]+', '') END AS norm_op
  FROM (SELECT *, CASE WHEN op = 'NOP' THEN NULL ELSE op || CASE kind
      WHEN 'alu' THEN ' REG, REG, IMM, ZERO' WHEN 'mem' THEN ' REG, MEM' WHEN 'pred' THEN ' PRED, PRED, REG, REG, PRED'
      WHEN 'const' THEN ' REG, CONST' WHEN 'bra' THEN ' LABEL' WHEN 'call' THEN ' LABEL'
      WHEN 'sreg' THEN ' REG, SREG' ELSE '' END END AS body FROM ins))"""

# --------------------------------------------------------------------------
# device and process samples, from lineitem

def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"]
    rows = ordered.ordinal(rows, ["l_suppkey"], order, [ordered.bucket_of("l_orderkey")], "n")
    return rows.withColumn("n", F.col("n") + 1)


def device_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sample_rows(spark, sf_dir)
    # Every 40 samples the clock jumps by 16 seconds, so runs have gaps but no sample is left out.
    second = F.col("n") + 16 * F.expr("(n + 20) div 40")
    return rows.select(
        F.col("l_suppkey").alias("run_id"),
        F.lit("gpu0").alias("gpu_uuid"),
        "n",
        (F.lit(1_700_000_000_000_000_000) + second * 1_000_000_000 + F.col("l_partkey") % 100 * 1_000_000)
        .alias("timestamp_ns"),
        (F.col("l_quantity") * 2).alias("gpu_utilization_pct"),
        (F.col("l_discount") * 1000).alias("memory_utilization_pct"),
        (40 + F.col("l_partkey") % 210).cast("double").alias("power_usage_watts"),
        (30 + 5 * F.round(F.col("l_tax") * 100)).alias("temperature_celsius"),
        F.when(F.col("l_linenumber") % 2 != 0, (F.col("l_partkey") % 100).cast("double")).alias("fan_speed_pct"),
        "l_linenumber", "l_quantity", "l_partkey",
    )


def process_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_side(device_samples(spark, sf_dir))


def process_side(rows: DataFrame) -> DataFrame:
    """Process samples beside ``device_samples``."""
    return rows.select(
        "run_id", "gpu_uuid", (100 + F.col("run_id") % 3).alias("pid"),
        (F.col("timestamp_ns") + 300_000_000).alias("timestamp_ns"),
        F.when(F.col("l_linenumber") != 7, 60 + F.col("l_quantity") * 0.8).alias("process_gpu_utilization_pct"),
        (85 + F.col("l_partkey") % 15).cast("double").alias("process_gpu_memory_pct"),
        (3 + F.col("l_partkey") % 20 / 10).alias("host_ram_gb"),
    )


SQL["v4"] = """
v4 AS (
  SELECT l_suppkey AS run_id, 'gpu0' AS gpu_uuid, n,
    1700000000000000000 + (n + 16 * ((n + 20) // 40)) * 1000000000 + (l_partkey % 100) * 1000000 AS timestamp_ns,
    l_quantity * 2 AS gpu_utilization_pct, l_discount * 1000 AS memory_utilization_pct,
    CAST(40 + l_partkey % 210 AS DOUBLE) AS power_usage_watts,
    30 + 5 * round(l_tax * 100) AS temperature_celsius,
    CASE WHEN l_linenumber % 2 <> 0 THEN CAST(l_partkey % 100 AS DOUBLE) END AS fan_speed_pct,
    l_linenumber, l_quantity, l_partkey
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS BIGINT) AS n FROM lineitem))"""

SQL["v4b"] = """
v4b AS (
  SELECT run_id, gpu_uuid, 100 + run_id % 3 AS pid, timestamp_ns + 300000000 AS timestamp_ns,
    CASE WHEN l_linenumber <> 7 THEN 60 + l_quantity * 0.8::DOUBLE END AS process_gpu_utilization_pct,
    CAST(85 + l_partkey % 15 AS DOUBLE) AS process_gpu_memory_pct, 3 + (l_partkey % 20) / 10.0::DOUBLE AS host_ram_gb
  FROM v4)"""

# --------------------------------------------------------------------------
# examples and run predictions, from documents and labels

CLASSES = ["benign_compute_like", "benign_crypto_hash_like", "benign_memory_like", "mining_like"]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    group = F.floor(F.col("doc_id") / 3).cast("long")
    names = F.array(*[F.lit(c) for c in CLASSES])
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("workload"),
        group.alias("group_id"),
        (group % 4).alias("label_id"),
        names[(group % 4).cast("int")].alias("label"),
        F.when(group % 4 == 3, "mining").otherwise("benign").alias("binary_label"),
        F.when(F.col("doc_id") % 2 == 0, "O2").otherwise("O3").alias("opt_level"),
        F.col("lang").alias("family"),
        (F.col("n_chars") % 101 / 100).alias("score"),
        F.col("quality").alias("truth"),
    )
    return rows.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


SQL["v5"] = f"""
v5 AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (
    SELECT d.doc_id AS workload, d.doc_id // 3 AS group_id, (d.doc_id // 3) % 4 AS label_id,
      {_LIST(CLASSES)}[(d.doc_id // 3) % 4 + 1] AS label,
      CASE WHEN (d.doc_id // 3) % 4 = 3 THEN 'mining' ELSE 'benign' END AS binary_label,
      CASE WHEN d.doc_id % 2 = 0 THEN 'O2' ELSE 'O3' END AS opt_level, d.lang AS family,
      (d.n_chars % 101) / 100.0::DOUBLE AS score, l.quality AS truth
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l
      ON l.doc_id = d.doc_id))"""

# --------------------------------------------------------------------------
# chunk probabilities, from embeddings


def _index_is(part: int, parts: int):
    return lambda _, k: k % parts == part


def chunk_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, including those of workloads that later lose their windows."""
    rows = table(spark, sf_dir, "embeddings")
    # Logit i is ten times the sum of the components whose index is i modulo 4.
    logits = F.array(*[F.aggregate(F.filter(F.col("embedding").cast("array<double>"), _index_is(i, 4)), F.lit(0.0), lambda a, x: a + x) * 10 for i in range(4)])
    workload = F.floor(F.col("vec_id") / 4).cast("long")
    return rows.select(
        F.col("vec_id"), workload.alias("workload"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        logits.alias("logits"), (workload % 4).alias("label_id"), F.floor(workload / 5).cast("long").alias("group_id"),
        (workload % 7).alias("session_id"),
    )


SQL["v6"] = """
v6 AS (
  SELECT vec_id, vec_id // 4 AS workload, vec_id % 4 AS chunk_index, (vec_id // 4) % 4 AS label_id,
    vec_id // 20 AS group_id, (vec_id // 4) % 7 AS session_id,
    list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, k: k % 4 = 1)) * 10 AS x0, list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, k: k % 4 = 2)) * 10 AS x1,
    list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, k: k % 4 = 3)) * 10 AS x2, list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda x, k: k % 4 = 0)) * 10 AS x3
  FROM embeddings),
prob4 AS (
  SELECT *, exp(x0 - m) / s AS p0, exp(x1 - m) / s AS p1, exp(x2 - m) / s AS p2, exp(x3 - m) / s AS p3 FROM (
    SELECT *, exp(x0 - m) + exp(x1 - m) + exp(x2 - m) + exp(x3 - m) AS s
    FROM (SELECT *, greatest(x0, x1, x2, x3) AS m FROM v6))),
prob2 AS (
  SELECT *, exp(y0 - m) / s AS p0, exp(y1 - m) / s AS p1 FROM (
    SELECT *, exp(y0 - m) + exp(y1 - m) AS s FROM (SELECT *, greatest(y0, y1) AS m FROM (SELECT *, x0 + x2 AS y0, x1 + x3 AS y1 FROM v6))))"""

SQL["long4"] = """
long4 AS (
  SELECT workload, chunk_index, label_id, group_id, session_id, vec_id, unnest([0, 1, 2, 3]) AS class_id,
    unnest([p0, p1, p2, p3]) AS p FROM prob4)"""

# --------------------------------------------------------------------------
# captures and planned runs, from orders and customer


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(c) for c in CLASSES])
    percents = F.array(*[F.lit(x) for x in (100, 75, 50, 25, 10, 5)])
    counts = F.create_map(F.lit("code"), 1 + key % 3, F.lit("kernel_launch"), F.col("o_custkey") % 4)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("capture_id"),
        F.concat(F.lit("captures/"), key.cast("string")).alias("capture_path"),
        F.concat("c_mktsegment", F.lit(" "), "o_orderpriority", F.lit("_o"), 2 + key % 2).alias("workload"),
        F.col("c_mktsegment").alias("program"),
        F.col("o_orderstatus").alias("variant"),
        F.col("o_orderpriority").alias("family"),
        names[(key % 4).cast("int")].alias("label"),
        percents[(key % 6).cast("int")].alias("target_percent"),
        (1 + key % 3).alias("repeat"),
        F.when(F.col("o_custkey") % 2 == 0, 60).otherwise(600).alias("runtime_sec"),
        F.when(key % 13 == 0, "skipped_missing_executable").otherwise("ok").alias("status"),
        F.when(key % 9 != 0, counts).alias("event_type_counts"),
        F.col("o_custkey").alias("custkey"),
    )


SQL["v7"] = f"""
v7 AS (
  SELECT o_orderkey AS capture_id, 'captures/' || o_orderkey AS capture_path,
    c_mktsegment || ' ' || o_orderpriority || '_o' || (2 + o_orderkey % 2) AS workload,
    c_mktsegment AS program, o_orderstatus AS variant, o_orderpriority AS family,
    {_LIST(CLASSES)}[o_orderkey % 4 + 1] AS label, [100, 75, 50, 25, 10, 5][o_orderkey % 6 + 1] AS target_percent,
    1 + o_orderkey % 3 AS repeat, CASE WHEN o_custkey % 2 = 0 THEN 60 ELSE 600 END AS runtime_sec,
    CASE WHEN o_orderkey % 13 = 0 THEN 'skipped_missing_executable' ELSE 'ok' END AS status,
    CASE WHEN o_orderkey % 9 <> 0 THEN 1 + o_orderkey % 3 END AS n_code,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 4 END AS n_launch, o_custkey AS custkey
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def sql(body: str, *views: str) -> str:
    """DuckDB text of a check: the named views in order, then ``body``.

    A body that adds tables of its own starts with a comma.
    """
    return ("WITH " + ",\n".join(SQL[v].strip() for v in views) + "\n" if views else "") + body
