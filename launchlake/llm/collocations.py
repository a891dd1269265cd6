"""Collocations by prefix-free parsing.

Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at blanks and
tabs. A piece is parsed into chunks: a new chunk starts at every trigger, a word whose hash is
divisible by ``trigger``, so equal passages are cut at the same places wherever they stand. A chunk
carries, after its own words, the next ``longest - 1`` words of its piece; chunks so overlap enough for every
phrase to lie whole in the chunk in which it starts, and it is counted there and nowhere else.
The distinct chunks of a language and the number of times each was parsed are the dictionary.
All phrases are counted inside distinct chunks, weighted by that number.

Words are counted first. A longer phrase can only be frequent if the two phrases one word shorter
in it are, so phrases of ``k`` words are counted where both of theirs fall on set bits of a table of
``BITS`` bits, filled from all frequent phrases of ``k - 1`` words. The table has a fixed size; two phrases on one
bit only cost extra counting. All counts are exact.

A candidate is a phrase of 2 to ``longest`` words with ``a >= least`` occurrences. Cut after its first k words it
scores ``floor(1000000 * a * a / (l * r))``, computed with 38 digits; the lowest-scoring cut counts, ties to the
smallest k. A candidate that lies inside a longer one with at least half of its occurrences is dropped.
The first ``top`` of a language are found by cutting at exact score histograms, then by salted and whole ranking, so
no language is sorted in one task.

Null texts are empty, null languages ``und``. Repeated rows count each time. Extra columns are not read.
Texts of any length are parsed piece by piece; an empty table gives an empty table. A language without candidates has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlake.llm.common import bounded, settle

UNDETERMINED = "und"
TRIGGER = 12
BITS = 1 << 26
# Words of chunks counted together in a task, and rows it hands on at once.
HELD = 1_000_000
ROWS = 100_000
SALTS = 64
SCALE = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word (none is empty): its bytes times powers of a prime, summed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    lengths = np.diff(ends)
    powers = np.cumprod(np.full(lengths.max(), _PRIME))
    h = np.add.reduceat(letters * powers[_within(lengths)], ends[:-1] - ends[0])
    return h ^ (h >> np.uint64(31))


def _encoded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of every token, and the distinct tokens in order of appearance."""
    encoded = pc.dictionary_encode(tokens)
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The length of every list, and all values."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _within(lengths: np.ndarray) -> np.ndarray:
    """The place of every value in its list."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def parse(texts: pa.Array, langs: pa.Array, trigger: int, context: int) -> pa.Table:
    """lang, own, chunk and times of the chunks of some texts."""
    pieces_of, pieces = _lists(pc.split_pattern_regex(pc.ascii_lower(texts), r"[.,;:!?\x0A-\x0D]+"))
    words_of, words = _lists(pc.split_pattern(pc.replace_substring(pieces, "\t", " "), " "))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    piece = np.repeat(np.arange(len(words_of)), words_of)[full]
    words = words.filter(pa.array(full))
    if not len(words):
        return pa.table({"lang": pa.array([], pa.string()), "own": pa.array([], pa.int32()), "chunk": pa.array([], pa.string()), "times": pa.array([], pa.int64())})
    opens = np.concatenate(([True], piece[1:] != piece[:-1])) | (_hashes(words) % np.uint64(trigger) == 0)
    starts = np.flatnonzero(opens)
    own = np.diff(np.append(starts, len(words)))
    # The end of a chunk: some words on, but within its piece.
    piece_end = np.searchsorted(piece, piece[starts], side="right")
    lengths = np.minimum(own + context, piece_end - starts)
    at = np.repeat(starts, lengths) + _within(lengths)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    chunk = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(at))), " ")
    text = np.repeat(np.arange(len(pieces_of)), pieces_of)[piece[starts]]
    table = pa.table({"lang": langs.take(pa.array(text)), "own": pa.array(own.astype(np.int32)), "chunk": chunk})
    counted = table.group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
    return counted.rename_columns(["lang", "own", "chunk", "times"]).cast(pa.schema([("lang", pa.string()), ("own", pa.int32()), ("chunk", pa.string()), ("times", pa.int64())]))


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", trigger: int = TRIGGER, longest: int = 3) -> DataFrame:
    """lang, own, chunk and times: every distinct chunk with the number of times it was parsed."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parse(batch.column(0), batch.column(1), trigger, longest - 1).to_batches(ROWS)

    rows = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit(UNDETERMINED)).alias("lang")).filter("text is not null")
    chunked = rows.mapInArrow(parsed, "lang string, own int, chunk string, times long")
    return settle(chunked.groupBy("lang", "own", "chunk").agg(F.sum("times").alias("times")), "chunk-dictionary")


def _bits(name: str, parts: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit of every phrase; ``parts`` are the hashes of its words."""
    h = np.full(len(parts[0]), crc32(name.encode()), np.uint64)
    for part in parts:
        h = (h ^ part) * _PRIME
        h ^= h >> np.uint64(29)
    return h % np.uint64(bits)


def count(name: str, table: pa.Table, size: int, bits: np.ndarray | None) -> pa.Table:
    """phrase and f: the phrases of ``size`` words in some chunks of one language, weighted, each where it starts."""
    lengths, tokens = _lists(pc.split_pattern(table["chunk"].combine_chunks(), " "))
    ids, distinct = _encoded(tokens)
    at = _within(lengths)
    starts = np.flatnonzero((at < np.repeat(table["own"].to_numpy(), lengths)) & (at + size <= np.repeat(lengths, lengths)))
    if bits is not None:
        sums = _hashes(distinct)[ids]
        parts = [sums[starts + k] for k in range(size)]
        held = [_bits(name, part, len(bits) * 8) for part in (parts[:-1], parts[1:])]
        starts = starts[np.logical_and(*[bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1 for b in held])]
    times = np.repeat(table["times"].to_numpy(), lengths)[starts]
    # Phrases are numbered word by word, so that numbers stay small.
    code = ids[starts]
    for k in range(1, size):
        code = _encoded(pa.array(code))[0] * len(distinct) + ids[starts + k]
    number, phrases = _encoded(pa.array(code))
    f, first = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
    np.add.at(f, number, times)
    first[number[::-1]] = np.arange(len(number))[::-1]
    words = [distinct.take(pa.array(ids[starts[first] + k])) for k in range(size)]
    return pa.table({"phrase": pc.binary_join_element_wise(*words, " ") if size > 1 else words[0], "f": pa.array(f)})


def count_phrases(chunked: DataFrame, size: int, least: int, table: bytes | None = None) -> DataFrame:
    """lang, size, phrase and f of the phrases of ``size`` words that occur ``least`` times or more.

    With a ``table`` of bits, only places are counted where both phrases of one word less are on set bits.
    """
    shared = chunked.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared else None

        def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            for name in pc.unique(rows["lang"]).to_pylist():
                found = count(name, rows.filter(pc.equal(rows["lang"], name)), size, bits)
                for part in found.combine_chunks().to_batches(ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.full(len(part), size, np.int32)), *part.columns], names=["lang", "size", "phrase", "f"])

        held, words = [], 0
        for batch in batches:
            held.append(batch)
            words += pc.sum(batch.column("own")).as_py() or 0
            if words >= HELD:
                yield from counted(held)
                held, words = [], 0
        if words:
            yield from counted(held)

    counts = chunked.select("lang", "own", "chunk", "times").mapInArrow(walk, "lang string, size int, phrase string, f long")
    return settle(counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "frequent-phrases")


def _table(phrases: DataFrame, size: int, bits: int) -> bytes:
    """The bits of all ``phrases`` of ``size`` words: at most ``bits // 64`` longs come to the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                ids, distinct = _encoded(pc.split_pattern(batch.column(1).filter(pc.equal(batch.column(0), name)), " ").flatten())
                sums = _hashes(distinct)[ids].reshape(-1, size)
                at = _bits(name, [sums[:, k] for k in range(size)], bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "b"])

    filled = phrases.filter(F.col("size") == size).select("lang", "phrase").mapInArrow(fill, "at long, b long").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    longs = np.zeros(-(-bits // 64), np.int64)
    longs[filled["at"].to_numpy()] = filled["b"].to_numpy()
    return longs.astype("<i8").tobytes()


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, trigger: int = TRIGGER, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words with their counts, and lang and n, the number of words of every language."""
    chunked = dictionary(docs, text, lang, trigger, longest)
    totals = chunked.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    found = count_phrases(chunked, 1, least)
    for size in range(2, longest + 1):
        found = found.unionByName(count_phrases(chunked, size, least, _table(found, size - 1, bits)))
    return found, totals


def _parts(size: int, first: int, last: int) -> Column:
    return F.array_join(F.slice("words", first + 1, last - first), " ")


def candidates(found: DataFrame, longest: int = 3, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r and score of the phrases of two words and more that no longer one stands for."""
    digits = "decimal(16,0)"
    counts = found.select("lang", "phrase", "f")
    scored = None
    for size in range(2, longest + 1):
        whole = found.filter(F.col("size") == size).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
        for k in range(1, size):
            for side, part in ((f"l{k}", _parts(size, 0, k)), (f"r{k}", _parts(size, k, size))):
                whole = whole.withColumn("part", part).join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias(side)), ["lang", "part"]).drop("part")
        product = lambda x, y: F.col(x).cast(digits) * F.col(y).cast(digits)
        whole = whole.withColumn("square", product("a", "a") * F.lit(SCALE).cast("decimal(7,0)"))
        for k in range(1, size):
            whole = whole.withColumn(f"lr{k}", product(f"l{k}", f"r{k}")).withColumn(f"score{k}", F.expr(f"square div lr{k}"))
        best = F.least(*[F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]) if size > 2 else F.struct(
            F.col("score1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))
        rows = whole.select("lang", "phrase", "a", best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        scored = rows if scored is None else scored.unionByName(rows)
    # A phrase inside a longer one: every longer candidate names the shorter ones in it.
    longer = found.filter(F.col("size") > 2).select("lang", "size", "f", F.split("phrase", " ").alias("words"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda at: F.array_join(F.slice("words", at, k), " "))))
    most = longer.select("lang", "f", F.explode(F.array_distinct(inside)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    return settle(kept.drop("longer"), "collocation-candidates")


def _above(rows: DataFrame, bucket: Column, top: int) -> DataFrame:
    """``rows`` without those whose bucket lies below the one that holds the language's row number ``top``."""
    counts = rows.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    listed = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n")), asc=False).alias("counts"))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("cut"))
    cut = F.aggregate("counts", start, lambda s, c: F.when(s.upto >= top, s).otherwise(F.struct((s.upto + c.n).alias("upto"), c.bucket.cast("long").alias("cut"))))
    return rows.join(bounded(settle(listed.select("lang", cut.cut.alias("cut")), "score-cuts")), "lang").filter(bucket >= F.col("cut")).drop("cut")


def first_of_each(rows: DataFrame, top: int = 2000) -> DataFrame:
    """``rows`` (lang, phrase, a, score, ...) with rank: the first ``top`` of every language."""
    # At most 1001 thousands of a score, then at most 1001 buckets: the thousands above, and the scores in the last.
    rows = settle(_above(rows, F.floor(F.col("score") / 1000), top), "high-thousands")
    last = settle(rows.groupBy("lang").agg(F.floor(F.min("score") / 1000).alias("last")), "last-thousands")
    rows = _above(rows.join(bounded(last), "lang"), F.when(F.floor(F.col("score") / 1000) > F.col("last"), F.lit(SCALE + 1)).otherwise(F.col("score")), top).drop("last")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, top: int = 2000, **parsing: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` collocations of every language."""
    found, totals = frequent_phrases(docs, text, lang, longest, least, **parsing)
    return first_of_each(candidates(found, longest), top).join(bounded(settle(totals, "words-of-languages")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
