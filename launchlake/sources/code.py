"""Code objects and disassembly listings as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlake.functions.text import let


def read_code_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a code folder as (path, content) rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path).select("path", "content")


def code_format(content: Column | str) -> Column:
    """cubin, fatbin, ptx or unknown, from the first 256 bytes."""
    head = F.substring(F.col(content) if isinstance(content, str) else content, 1, 256)
    digits = F.hex(head)
    plain = digits.rlike("^(?:0A|0D|09|[2-6][0-9A-F]|7[0-9A-E])+$")
    text = F.lower(F.decode(head, "ISO-8859-1"))
    marked = text.contains(".version") | text.contains(".target") | text.contains(".entry")
    return (
        F.when(digits.startswith("7F454C46"), "cubin")
        .when(digits.startswith("50ED55BA") | digits.startswith("BA55ED50"), "fatbin")
        .when(plain & marked, "ptx").otherwise("unknown"))


def check_code_objects(objects: DataFrame) -> DataFrame:
    """Verify declared size and hash, refuse escaping paths, name the format.

    Takes code_id, path, content, declared_sha256, declared_size. Nothing is
    dropped: ``reject_reason`` is null for good objects.
    """
    rows = objects.withColumns({
        "sha256": F.sha2("content", 256), "size": F.length("content").cast("long"), "format": code_format("content")})
    depth = F.aggregate(
        F.filter(F.split("path", "/"), lambda p: (p != "") & (p != ".")), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"),
            F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    reason = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "missing path")
        .when(F.col("path").startswith("/") | (depth["low"] < 0), "path escapes capture directory")
        .when(F.lower("declared_sha256") != F.col("sha256"), "sha256 mismatch")
        .when(F.col("declared_size") != F.col("size"), "size mismatch"))
    return rows.withColumn("reject_reason", reason)


def disassembly_report(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Status roll-up of code objects per capture; fails without any ok one.

    ``has_listing`` tells whether a listing came with the object.
    """
    status = (F.when(F.col("format") == "ptx", "ptx_only").when(F.col("format") == "unknown", "error")
              .when(F.col("has_listing"), "ok").otherwise("error"))
    rows = objects.withColumn("status", status)
    # a hash that was disassembled before is not disassembled again
    per_hash = rows.groupBy(*keys, "sha256", "status").agg(F.count(F.lit(1)).alias("n"))
    out = per_hash.groupBy(*keys).agg(
        F.sum(F.when(F.col("status") == "ok", F.col("n")).otherwise(0)).alias("ok"),
        F.sum(F.when(F.col("status") == "ptx_only", F.col("n")).otherwise(0)).alias("ptx_only"),
        F.sum(F.when(F.col("status") == "error", F.col("n")).otherwise(0)).alias("error"),
        F.sum(F.when(F.col("status") == "ok", F.col("n") - 1).otherwise(0)).alias("deduplicated"))
    return out.withColumn("failed", F.col("ok") == 0)


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _functions(text: Column, marked: Column) -> Column:
    """(function, body) of a listing text in order."""
    first = F.transform(
        F.slice(F.split(text, r"\bFunction\s*:\s*"), 2, 1 << 30),
        lambda s: F.when(
            s.rlike(r"\n[ \t]*\.headerflags\b"),
            F.struct(F.regexp_replace(s, r"(?s)\n[ \t]*\.headerflags\b.*$", "").alias("function"),
                     F.regexp_replace(s, r"(?s)^.*?\n[ \t]*\.headerflags\b", "").alias("body")),
        ).otherwise(F.struct(F.trim(F.regexp_extract(s, r"^([^\n]*)", 1)).alias("function"),
                             F.regexp_replace(s, r"^[^\n]*\n?", "").alias("body"))))
    names = F.regexp_extract_all(text, F.lit(r"\.type[ \t]+([^,\s]+)[ \t]*,[ \t]*@function"), F.lit(1))
    # looked for at the start of a line only: anywhere else the rest of the line would be read again for every character
    bodies = F.slice(F.split(text, r"(?<![^\n])[^\n]*\.type[ \t]+[^,\s]+[ \t]*,[ \t]*@function[^\n]*"), 2, 1 << 30)
    second = F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda z: F.struct(z["n"].alias("function"), z["b"].alias("body")))
    return F.when(marked, first).otherwise(second)


def _instructions(body: Column, marked: Column) -> Column:
    """(addr, text) of the instructions in a body. First dialect: any number per line; second: the first one of each line."""
    anywhere = r"/\*[0-9a-fA-F]+\*/\s*.*?\s*;"
    per_line = r"/\*[0-9a-fA-F]+\*/[^\n]*?;[^\n]*"
    # a body is searched once; what is found is cut without patterns
    found = F.when(marked, F.regexp_extract_all(body, F.lit(anywhere), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(per_line), F.lit(0)))
    addr = lambda m: F.substring(F.substring_index(m, "*/", 1), 3, 1 << 30)
    pairs = F.transform(found, lambda m: F.struct(
        F.lower(addr(m)).alias("addr"), _clean(F.substring_index(F.substr(m, F.length(addr(m)) + 5), ";", 1)).alias("text")))
    return F.filter(pairs, lambda x: x["text"] != "")


def _last_of_each(found: Column, marked: Column) -> Column:
    """Functions by name: the place of the first of that name, the place and the instructions of the last."""
    real = F.filter(found, lambda f: ~marked | (F.size(f["ins"]) > 0))
    named = F.array_sort(F.transform(real, lambda f: F.struct(f["function"].alias("function"), f["ord"].alias("ord"))))
    same = lambda a, x, i: F.get(a, i)["function"].eqNullSafe(x["function"])
    return let(named, lambda a: F.zip_with(
        F.filter(a, lambda x, i: (i == 0) | ~same(a, x, i - 1)), F.filter(a, lambda x, i: (i == F.size(a) - 1) | ~same(a, x, i + 1)),
        lambda f, z: F.struct(f["function"].alias("function"), f["ord"].alias("ord"), z["ord"].alias("last"), F.get(found, z["ord"])["ins"].alias("ins"))))


def read_listings(files: DataFrame, key: str = "code_id", whole: bool = False) -> DataFrame:
    """(key, function, ord, idx, addr, text) from whole listing texts.

    Two dialects: ``Function :`` markers whose names may span lines, and
    ``.type name,@function`` lines. A later function of the same name replaces
    the earlier body; functions without instructions vanish in the first
    dialect only (the second keeps them as one row without text). With ``whole``, every row of ``files``
    is a listing of its own, and nothing is shuffled; else rows of one key are one listing.
    """
    marked = F.col("marked")
    rows = files.select(key, "text", F.col("text").contains("Function :").alias("marked"))
    # outer, and of one element: else the optimizer would filter by the size of what is found, and read every text three times
    rows = rows.select(key, "marked", F.explode_outer(F.array(_functions(F.col("text"), marked))).alias("parts"))
    found = F.transform("parts", lambda f, i: F.struct(f["function"].alias("function"), i.alias("ord"), _instructions(f["body"], marked).alias("ins")))
    rows = rows.select(key, "marked", F.explode_outer(F.array(found)).alias("found"))
    rows = rows.select(key, F.explode_outer(_last_of_each(F.col("found"), marked)).alias("f")).where(F.col("f").isNotNull())
    rows = rows.select(key, "f.function", "f.ord", "f.last", "f.ins")
    if not whole:
        rows = rows.groupBy(key, "function").agg(F.max_by("ins", "last").alias("ins"), F.min("ord").alias("ord"))
    return rows.select(key, "function", "ord", F.posexplode_outer("ins").alias("idx", "i")).select(
        key, "function", "ord", "idx", "i.addr", "i.text")
