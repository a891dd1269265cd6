"""Linking, ordering and checking tool calls of chats, as canonical JSON.

Calls and results are joined by conversation and identifier. Calls are ordered
topologically: a call's level is the longest chain of calls it needs, and calls are placed by
level, turn and identifier. Chains of calls that need one other call each are contracted by
doubling, so a conversation of any length takes a logarithmic number of rounds; calls that
need several are resolved round by round. Arguments are checked against the schema of their
tool. Everything is a DataFrame expression; JSON is parsed and written by the engine, with
keys in order and without white space.

Definitions: rows without a conversation or an identifier can't be linked and are left out.
Of repeated calls or results with one identifier the first by turn (then by content) stands,
and the numbers are reported. Needed calls that don't exist are reported and don't count for
the level. Calls on a cycle, or behind one, have no level and come last. Arguments that are
no JSON object are reported and kept as a string. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlake.llm.common import settle
from launchlake.operators.ordered import bucket_of, ordinal

ID = ["conv_id", "call_id"]


def _first(rows: DataFrame, columns: list[str], count: str) -> DataFrame:
    """The first row of every identifier by turn, and how many there are."""
    known = rows.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    return known.groupBy(*ID).agg(F.min(F.struct("turn", *columns)).alias("f"), F.count("*").alias(count)).select(*ID, "f.*", count)


def _chains(single: DataFrame) -> DataFrame:
    """node, anchor and steps: where each chain of single needs ends. Nodes on cycles are left out."""
    single = settle(single, "chains")
    ends, bound, rounds = single, single.count(), 0
    while True:
        onward = ends.select(F.col("node").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        step = ends.join(onward, "anchor", "left").select("node", F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                                                          F.col("next").isNotNull().alias("moved"))
        step = settle(step, "chains")
        rounds += 1
        moved = step.filter("moved").limit(1).count()
        ends = step.select("node", "anchor", "steps")
        if not moved:
            return ends
        if 1 << (rounds - 1) > bound:  # whoever moved from so far on goes round in a circle
            return step.filter("not moved").select("node", "anchor", "steps")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level and missing (needed calls that don't exist), for calls with ``needs``."""
    nodes = settle(calls.select(F.struct(*ID).alias("node"), "needs"), "call-nodes")
    wanted = nodes.select("node", F.explode(F.array_distinct("needs")).alias("need")).filter("need is not null").select(
        "node", F.struct(F.col("node.conv_id").alias("conv_id"), F.col("need").alias("call_id")).alias("need"))
    there = nodes.select(F.col("node").alias("need"), F.lit(True).alias("there"))
    edges = settle(wanted.join(there, "need", "left"), "call-needs")
    missing = edges.filter("there is null").groupBy("node").agg(F.sort_array(F.collect_list("need.call_id")).alias("missing"))
    edges = edges.filter("there")
    degree = settle(edges.groupBy("node").agg(F.count("*").alias("d"), F.min("need").alias("need")), "call-degrees")
    ends = _chains(degree.filter("d = 1").select("node", F.col("need").alias("anchor"), F.lit(1).alias("steps")))
    known = settle(nodes.join(degree, "node", "left_anti").select("node", F.lit(0).alias("level")), "call-levels")
    several = degree.filter("d > 1").select("node", "d")
    if several.limit(1).count():
        reach = edges.join(several, "node").join(ends.select(F.col("node").alias("need"), "anchor", "steps"), "need", "left").select(
            "node", "d", F.coalesce("anchor", "need").alias("anchor"), F.coalesce("steps", F.lit(0)).alias("steps"))
        reach = settle(reach, "call-reach")
        while True:
            open_ = reach.join(known.select("node"), "node", "left_anti")
            solved = open_.join(known.select(F.col("node").alias("anchor"), "level"), "anchor").groupBy("node", "d").agg(
                F.count("*").alias("n"), F.max(F.col("level") + F.col("steps") + 1).alias("level")).filter("n = d").select("node", "level")
            solved = settle(solved, "call-levels")
            if not solved.limit(1).count():
                break
            known = settle(known.union(solved), "call-levels")
    along = ends.join(known.select(F.col("node").alias("anchor"), "level"), "anchor").select("node", (F.col("level") + F.col("steps")).alias("level"))
    found = known.union(along)
    return nodes.select("node").join(found, "node", "left").join(missing, "node", "left").select("node.*", "level", "missing")


def _type_fits(expected: Column, found: Column) -> Column:
    """Whether a value of the engine's type name ``found`` is of the JSON type ``expected``."""
    kind = (F.when(found == "BIGINT", "integer").when(found == "STRING", "string").when(found == "BOOLEAN", "boolean").when(found == "VOID", "null")
            .when(found.startswith("ARRAY"), "array").when(found.startswith("OBJECT"), "object").otherwise("number"))
    return (kind == expected) | ((kind == "integer") & (expected == "number"))


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with errors: what is wrong with ``arguments`` by the schema of ``name``, sorted."""
    entries = F.map_from_entries(F.collect_set(F.struct("parameter", F.struct("type", "required"))))
    tools = schemas.filter("name is not null and parameter is not null").groupBy("name", "parameter").agg(
        F.min(F.struct("type", "required")).alias("rule")).select("name", "parameter", "rule.*").groupBy("name").agg(entries.alias("rules"))
    given = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    rows = calls.withColumn("_given", F.when(is_object, given)).join(tools, "name", "left")
    required = F.map_keys(F.map_filter("rules", lambda _, r: r["required"]))
    absent = F.transform(F.array_except(required, F.map_keys("_given")), lambda p: F.concat(F.lit("missing:"), p))
    unknown = F.transform(F.array_except(F.map_keys("_given"), F.map_keys("rules")), lambda p: F.concat(F.lit("unknown:"), p))
    wrong = F.transform(F.map_keys(F.map_filter("_given", lambda p, t: F.coalesce(~_type_fits(F.try_element_at("rules", p)["type"], t), F.lit(False)))),
                        lambda p: F.concat(F.lit("type:"), p))
    errors = (F.when(F.col("_given").isNull(), F.array(F.lit("not_an_object")))
              .when(F.col("rules").isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.array_sort(F.concat(absent, unknown, wrong))))
    return rows.withColumn("errors", errors).drop("_given", "rules")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier of a conversation: its level, place, status, errors and canonical JSON.

    calls: conv_id, turn, call_id, name, arguments (JSON), needs (identifiers);
    results: conv_id, turn, call_id, content; schemas: name, parameter, type, required.
    status is linked, early (the result stands before the call), unanswered or orphan (a result without a call).
    """
    first = settle(_first(calls, ["name", "arguments", "needs"], "n_calls"), "calls")
    answers = _first(results, ["content"], "n_results").withColumnRenamed("turn", "result_turn")
    checked = check_arguments(first, schemas).join(levels(first), ID, "left")
    rows = checked.join(answers, ID, "full")
    status = (F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered")
              .when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked"))
    rows = rows.withColumn("status", status).withColumn("_at", F.coalesce("turn", "result_turn")).withColumn("_level", F.coalesce("level", F.lit((1 << 31) - 1)))
    placed = ordinal(rows, ["conv_id"], ["_level", "_at", "call_id"], [F.col("_level"), bucket_of("_at", 4096)], "place")
    parsed = F.try_parse_json("arguments")
    line = F.to_json(F.struct(
        parsed.alias("arguments"), "call_id", F.col("content").alias("content"), "errors", "level", "missing", "name", "status",
        F.when(parsed.isNull(), F.col("arguments")).alias("unparsed")))
    return placed.select(*ID, "turn", "result_turn", "name", "status", "level", "place", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
                         F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce(F.size("errors"), F.lit(0)).alias("n_errors"),
                         F.coalesce(F.size("missing"), F.lit(0)).alias("n_missing"), line.alias("line"))
