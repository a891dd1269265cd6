"""Matching launches to code: name ladder, artifact joins, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 4


def canonical_name(name: Column | str) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, "\r\n?", "\n")


def compact_name(name: Column | str) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\s+", "")


def distinct_functions(functions: DataFrame) -> DataFrame:
    """One row per (code_id, function): the later body, the earlier place."""
    return functions.groupBy("code_id", "function").agg(
        F.max_by("n_instr", "ord").alias("n_instr"), F.min("ord").alias("ord"))


def resolve_names(pairs: DataFrame, functions: DataFrame, use_size: bool = True) -> DataFrame:
    """Best function for each distinct (kernel_name, code_id).

    Ladder: exact, equal after newline folding, substring either way without
    blanks, largest function of the code object. Ties go to the longer, then
    the earlier function. The substring step is an equi-join on the rarest
    four characters of the shorter name, so the functions of one code object
    are never paired with all of its launched names. ``use_size=False`` is the live variant in which bodies
    have no length yet.
    """
    pairs = pairs.select("kernel_name", "code_id").distinct()
    funcs = distinct_functions(functions)
    size = F.col("n_instr") if use_size else F.lit(0)
    funcs = funcs.select("code_id", "function", size.cast("long").alias("n_instr"), "ord",
                         canonical_name("function").alias("canonical"), compact_name("function").alias("compact"))
    best = lambda rank: F.max(F.struct(
        F.lit(-rank).alias("r"), F.col("n_instr"), (-F.col("ord")).alias("o"), F.col("function")))

    exact = pairs.join(funcs, (pairs.kernel_name == funcs.function) & (pairs.code_id == funcs.code_id)).groupBy(
        pairs.kernel_name, pairs.code_id).agg(best(0).alias("hit"))
    folded = pairs.withColumn("canonical", canonical_name("kernel_name")).join(funcs, ["code_id", "canonical"]).groupBy(
        "kernel_name", "code_id").agg(best(1).alias("hit"))
    substring = _substring_matches(pairs, funcs).groupBy("kernel_name", "code_id").agg(best(2).alias("hit"))
    largest = funcs.groupBy("code_id").agg(best(3).alias("hit"))
    largest = pairs.join(largest, "code_id").select("kernel_name", "code_id", "hit")
    found = exact.unionByName(folded).unionByName(substring).unionByName(largest)
    found = found.groupBy("kernel_name", "code_id").agg(F.max("hit").alias("hit"))
    # Names of the ladder steps.
    steps = F.array(*[F.lit(s) for s in ("exact", "canonical_name", "substring_name", "largest_function_fallback")])
    return found.select("kernel_name", "code_id", F.col("hit.function").alias("function"),
                        F.col("hit.n_instr").alias("n_instr"), steps[-F.col("hit.r")].alias("match"))


def _grams(text: Column, size: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size)))


def containment_candidates(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(code_id, needle, text) pairs that share the needle's rarest gram.

    Takes distinct (code_id, needle) and (code_id, text). Grams are counted per
    code object first; a needle with a gram that no text has is inside none,
    and the others meet only the texts that hold their rarest gram, so names
    with a common beginning are not paired with each other.
    """
    short = F.least(F.lit(SEED), F.length("text"))
    grams = hay.select("code_id", "text", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), short), lambda n: _grams(F.col("text"), n)))).alias("seed"))
    spread = grams.groupBy("code_id", "seed").agg(F.count(F.lit(1)).alias("df"))
    own = needles.select("code_id", "needle", F.explode(_grams(F.col("needle"), F.least(F.lit(SEED), F.length("needle")))).alias("seed"))
    rarest = own.join(spread, ["code_id", "seed"], "left").groupBy("code_id", "needle").agg(
        F.min(F.struct("df", "seed")).alias("r"), F.count_if(F.col("df").isNull()).alias("absent")).where(F.col("absent") == 0)
    return rarest.select("code_id", "needle", F.col("r.seed").alias("seed")).join(grams, ["code_id", "seed"]).select("code_id", "needle", "text")


def _substring_matches(pairs: DataFrame, funcs: DataFrame) -> DataFrame:
    target = pairs.withColumn("target", compact_name("kernel_name")).where(~F.col("target").isin("", "$"))
    # an empty function name is inside every target and has no gram
    empty = target.join(funcs.where(F.col("compact") == ""), "code_id")
    named = funcs.where(F.col("compact") != "")
    targets, compacts = target.select("code_id", "target").distinct(), named.select("code_id", "compact").distinct()
    in_function = containment_candidates(targets.withColumnRenamed("target", "needle"), compacts.withColumnRenamed("compact", "text"))
    in_function = in_function.where(F.contains("text", "needle")).select("code_id", F.col("needle").alias("target"), F.col("text").alias("compact"))
    in_target = containment_candidates(compacts.withColumnRenamed("compact", "needle"), targets.withColumnRenamed("target", "text"))
    in_target = in_target.where(F.contains("text", "needle")).select("code_id", F.col("text").alias("target"), F.col("needle").alias("compact"))
    met = in_function.union(in_target).distinct()
    columns = ["kernel_name", "code_id", "function", "n_instr", "ord"]
    return target.join(met, ["code_id", "target"]).join(named, ["code_id", "compact"]).select(*columns).unionByName(empty.select(*columns))


def join_launch_kernel(launches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Attach the kernel artifact: by (name, code), by name, then by kernel id.

    The ladder runs once per distinct launch key; launches then take one
    equi-join against the small key table.
    """
    keys = launches.select("kernel_name", "code_id", "l0_kernel_id").distinct()
    arts = artifacts.withColumn("id_string", F.concat_ws(":", "code_id", "kernel_name"))
    direct = arts.groupBy("kernel_name", "code_id").agg(F.max_by("artifact", "ord").alias("direct"))
    by_name = arts.groupBy("kernel_name").agg(F.min_by("artifact", "ord").alias("by_name"))
    by_id = arts.groupBy(F.col("id_string").alias("l0_kernel_id")).agg(F.min_by("artifact", "ord").alias("by_id"))
    resolved = keys.join(direct, ["kernel_name", "code_id"], "left").join(by_name, "kernel_name", "left").join(
        by_id, "l0_kernel_id", "left")
    resolved = resolved.select(
        F.col("kernel_name").alias("_n"), F.col("code_id").alias("_c"), F.col("l0_kernel_id").alias("_i"),
        F.coalesce("direct", "by_name", "by_id").alias("artifact"),
        F.when(F.col("direct").isNotNull(), "name_and_code").when(F.col("by_name").isNotNull(), "name").when(
            F.col("by_id").isNotNull(), "kernel_id").otherwise("missing").alias("resolution"))
    same = (F.col("kernel_name").eqNullSafe(F.col("_n")) & F.col("code_id").eqNullSafe(F.col("_c"))
            & F.col("l0_kernel_id").eqNullSafe(F.col("_i")))
    return launches.join(resolved, same, "left").drop("_n", "_c", "_i")


def missing_kernels(launches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Distinct launched (name, code) without an artifact, with the reason."""
    keys = launches.groupBy("kernel_name", "code_id").agg(F.count(F.lit(1)).alias("launches"))
    gone = keys.join(artifacts.select("kernel_name", "code_id").distinct(), ["kernel_name", "code_id"], "left_anti")
    reason = F.when(F.coalesce("kernel_name", F.lit("")) == "", "missing name").otherwise(
        "launched kernel not found in disassembly")
    return gone.withColumn("reason", reason)


def dedup_by_hash(objects: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Point every object at the first one with the same hash.

    Sizes that disagree within one hash are flagged. Only hashes and ids are
    shuffled; a hash shared by very many objects is combined on the map side
    and its join partition is split by the adaptive skew join.
    """
    first = objects.groupBy(*keys).agg(
        F.min_by("code_id", order).alias("representative"), F.count(F.lit(1)).alias("copies"),
        (F.min("size") != F.max("size")).alias("size_conflict"))
    return objects.join(first, keys).withColumn("is_duplicate", F.col("code_id") != F.col("representative"))
