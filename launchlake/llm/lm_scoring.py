"""Context-tree weighting over bytes.

Texts are lower-cased (A-Z) bytes followed by an end symbol (0xFF, which UTF-8 never
holds). A byte is coded as eight binary decisions, each with a context tree of its own over the
``DEPTH`` bytes before. A node of a tree estimates its decision by Krichevsky-Trofimov and
mixes, half and half in advance, with what its children made of the same training data; so
every depth takes part with the weight that the data give it. Training counts are frozen
before scoring; contexts before a text are end symbols.

The weight of a node depends on its own subtree alone. Counts of (context, byte) are
dealt by the three nearest context bytes and each task works out the subtrees below; the top of
the tree, contexts of up to two bytes, has at most 65,536 x 255 nodes and is worked out on the
driver. Documents are dealt into blocks of about ``BLOCK_BYTES``, and every block gets the
probabilities of exactly the contexts, and the counts of the words, that occur in it; so
nothing that grows with the corpus is broadcast.

The unigram base score runs beside it: word counts are summed per word over the blocks.
Words are told apart by 62 bits of their XXH64 hash.

Null texts count as empty and hold the end only. Repeated rows are scored alike. Without
training rows every decision has probability one half. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from launchlake.llm.common import LOWER, settle

DEPTH = 5
END = 0xFF
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
WORD = 1 << 62  # keys of words have this bit, keys of grams (context and byte) don't
SPREAD = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 21
ROWS_AT_ONCE = 500  # of a block, when it is scored
WORDS_HELD = 100_000  # logs that are remembered between them


def _bytes(text: str | None) -> bytes:
    return text.encode().translate(LOWER) if text else b""


def word_key(word: bytes) -> int:
    """The key of a word; the empty word is the end of a text."""
    return WORD | xxhash.xxh64_intdigest(word) >> 2


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every symbol of the texts, ends included, and where each text starts."""
    joined = np.frombuffer(b"".join(b"\xff" * DEPTH + t + b"\xff" for t in texts), np.uint8).astype(np.uint64)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    rolled = joined[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        rolled |= joined[DEPTH - back:len(joined) - back] << np.uint64(8 * back)
    # The padding before each text but the first is no symbol.
    symbol = np.ones(len(rolled), bool)
    begins = np.cumsum(lengths + DEPTH)[:-1] - DEPTH
    for k in range(DEPTH):
        symbol[begins + k] = False
    return rolled[symbol].astype(np.int64), np.cumsum(lengths) - lengths


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 1/2: Stirling's series eight steps up."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum(np.log(x + k) for k in range(8))


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """The nodes of one depth: sorted keys (context and decision), counts, and log probabilities."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    kt: np.ndarray
    below: np.ndarray | None  # of the children together; None at full depth

    @property
    def mixed(self) -> np.ndarray:
        return self.kt if self.below is None else np.logaddexp(self.kt, self.below) - np.log(2)

    @property
    def own(self) -> np.ndarray:
        """The weight of the node's own estimate."""
        return np.ones(len(self.keys)) if self.below is None else 1 / (1 + np.exp(np.clip(self.below - self.kt, -700, 700)))

    @property
    def one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def _merged(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """Sum rows of equal keys into a level; also the place of each row in it."""
    found, at = np.unique(keys, return_inverse=True)
    zeros, ones = np.bincount(at, zeros, len(found)), np.bincount(at, ones, len(found))
    return Level(found, zeros, ones, kt_log(zeros, ones), None if below is None else np.bincount(at, below, len(found))), at


def _up(level: Level, depth: int) -> tuple[Level, np.ndarray]:
    """The parents of a level's nodes: their contexts lose the farthest byte."""
    context, node = level.keys >> 8, level.keys & 255
    return _merged((context & ((1 << 8 * (depth - 1)) - 1)) << 8 | node, level.zeros, level.ones, level.mixed)


def _decisions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions [gram, k] of each gram's byte, as nodes 1 to 255 of a binary tree, and their outcomes."""
    byte, k = (gram & 255)[:, None], np.arange(8)
    return (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1


def subtrees(gram: np.ndarray, count: np.ndarray, top: int = 3) -> tuple[np.ndarray, Level]:
    """For grams with all of their ``top``-byte contexts' grams present: the probability, from depth ``top``
    down, of each of their decisions' outcomes, and the level of depth ``top``."""
    node, bit = _decisions(gram)
    keys = (gram >> 8)[:, None] << 8 | node
    n = np.repeat(count.astype(float)[:, None], 8, axis=1)
    level, at = _merged(keys.ravel(), (n * (1 - bit)).ravel(), (n * bit).ravel(), None)
    levels, maps = [level], [at]
    for depth in range(DEPTH, top, -1):
        level, at = _up(level, depth)
        levels.append(level)
        maps.append(at)
    one = levels[-1].one
    # From the top down every node's estimate is mixed into what stands above it.
    remaining, total = 1 - levels[-1].own, levels[-1].own * one
    for level, at in zip(reversed(levels[:-1]), reversed(maps[1:])):
        total, remaining = total[at] + remaining[at] * level.own * level.one, remaining[at] * (1 - level.own)
    ones = total[maps[0]].reshape(bit.shape)
    return np.where(bit == 1, ones, 1 - ones), levels[-1]


class Top:
    """Depths 0 to 2: for each two-byte context and decision, what they contribute to a one, and the weight left below."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        level, _ = _merged(keys, zeros, ones, below)
        levels, maps = [level], []
        for depth in (2, 1):
            level, at = _up(level, depth)
            levels.append(level)
            maps.append(at)
        remaining, total = np.ones(len(level.keys)), np.zeros(len(level.keys))
        for i, level in enumerate(reversed(levels)):
            if i:
                at = maps[len(maps) - i]
                total, remaining = total[at], remaining[at]
            total, remaining = total + remaining * level.own * level.one, remaining * (1 - level.own)
        self.keys, self.ones, self.remaining = levels[0].keys, total, remaining

    def log10(self, gram: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte, given the probabilities of its outcomes from depth 3 down."""
        node, bit = _decisions(gram)
        at = np.searchsorted(self.keys, (gram >> 8 & 0xFFFF)[:, None] << 8 | node)
        ones, remaining = self.ones[at], self.remaining[at]
        above = np.where(bit == 1, ones, 1 - remaining - ones)
        return np.log10(above + remaining * below).sum(axis=1)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + DEPTH + 1
    if texts:
        yield start, len(texts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task by blocks of about BLOCK_BYTES."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            if size > BLOCK_BYTES:
                block, size = block + 1, 0
            size += len(t or "")
            numbers.append(block)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["block", *batch.schema.names])


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[bool]]]:
    """Runs of rows of one block: its number, texts and whether they train."""
    blocks = batch.column(0).to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(blocks[a]), [_bytes(t) for t in batch.column(2).slice(a, b - a).to_pylist()], batch.column(1).slice(a, b - a).to_pylist()


def _rows(block: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["block", "key", "n"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for block, parts in held.items():
            yield _rows(block, *_summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])))
        held.clear()

    for batch in batches:
        for block, texts, train in _by_block(batch):
            if block not in held:
                yield from out()
                held[block] = []
            for start, end in _slices(texts):
                for part in (True, False):
                    own = [texts[i] for i in range(start, end) if train[i] == part]
                    if own:
                        keys, counts = np.unique(grams(own)[0], return_counts=True)
                        held[block].append((keys, counts * part))
            if len(held[block]) > 16:
                held[block] = [_summed(np.concatenate([k for k, _ in held[block]]), np.concatenate([n for _, n in held[block]]))]
    yield from out()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    current = None

    def out() -> pa.RecordBatch:
        return _rows(current, np.array([word_key(w) for w in counts], np.int64), np.array(list(counts.values()), np.int64))

    for batch in batches:
        for block, texts, train in _by_block(batch):
            if block != current and counts:
                yield out()
                counts = Counter()
            current = block
            for text, learns in zip(texts, train):
                words = text.split()
                words.append(b"")
                if learns:
                    counts.update(words)
                else:
                    for w in words:
                        counts.setdefault(w, 0)
    if counts:
        yield out()


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their three-byte contexts: probabilities of grams (part 0) and nodes of depth 3 (part 1)."""
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def out(gram: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(gram):
            return
        below, level = subtrees(gram, count)
        nodes = np.stack([level.zeros, level.ones, level.mixed], axis=1)
        for part, keys, values in ((0, gram, below), (1, level.keys, nodes)):
            width = values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), lists], names=["part", "key", "values"])

    for batch in batches:
        gram, count = (np.concatenate((k, batch.column(i).to_numpy())) for i, k in enumerate(kept))
        context = gram >> 8 & 0xFFFFFF
        whole = int(np.searchsorted(context, context[-1])) if len(context) else 0
        yield from out(gram[:whole], count[:whole])
        kept = gram[whole:], count[whole:]
    yield from out(*kept)


class _Table:
    """Values by key: a table of places, and a search for keys whose place another key holds."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.places = np.zeros(1 << TABLE_BITS, np.int32)
        self.places[self._place(self.keys)] = np.arange(len(keys), dtype=np.int32)

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * SPREAD) >> np.uint64(64 - TABLE_BITS)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.places[self._place(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def _score(docs: pa.Table, needs: pa.Table) -> pa.Table:
    """Scores of a block's documents from the log probabilities and counts it needs."""
    keys, values = needs.column("key").to_numpy(), needs.column("value").to_numpy()
    is_word = keys >= WORD
    table = _Table(keys[~is_word], values[~is_word])
    count_of = _Table(keys[is_word], values[is_word])
    known: dict[bytes, float] = {}
    scores, n_tokens, n_known, base = [], [], [], []
    for batch in docs.select(["text"]).to_batches(max_chunksize=ROWS_AT_ONCE):
        texts = [_bytes(t) for t in batch.column(0).to_pylist()]
        for a, b in _slices(texts):
            gram, starts = grams(texts[a:b])
            scores.append(np.add.reduceat(table[gram], starts))
        if len(known) > WORDS_HELD:
            known.clear()
        for text in texts:
            words = text.split()
            words.append(b"")
            if new := [w for w in dict.fromkeys(words) if w not in known]:
                known.update(zip(new, np.log10(count_of[np.array([word_key(w) for w in new], np.int64)] + 0.1).tolist()))
            logs = np.array([known[w] for w in words])
            n_tokens.append(len(words))
            n_known.append(int((logs > -0.999).sum()))
            base.append(float(logs.sum()))
    # Each word that was trained is first in one block only.
    distinct = int((is_word & needs.column("first").to_numpy(zero_copy_only=False) & (values > 0)).sum())
    return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                     "logs": pa.array(base), "score": pa.array(np.concatenate(scores)), "distinct": pa.array([distinct] + [0] * (len(base) - 1), pa.int64())})


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row, learned from the rows that ``train``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    blocked = settle(rows.mapInArrow(_blocks, f"block long, doc_id {id_type}, train boolean, text string"), "blocks")
    texts = blocked.select("block", "train", "text")

    in_blocks = settle(texts.mapInArrow(_count_grams, "block long, key long, n long"), "grams")
    counts = in_blocks.groupBy("key").agg(F.sum("n").alias("n"))
    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    dealt = counts.repartition(near).sortWithinPartitions(near).select("key", "n")
    tree = settle(dealt.mapInArrow(_grow, "part int, key long, values array<double>"), "subtrees")
    nodes = tree.filter("part = 1").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(
        *[F.sum(F.get("values", F.lit(i))).alias(c) for i, c in enumerate(("zeros", "ones", "below"))]).toPandas()
    if nodes.empty:
        return blocked.select("doc_id", "train", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], *[F.lit(0.0).alias(c) for c in ("base_score", "score")])
    top = Top(nodes.key.to_numpy(), nodes.zeros.to_numpy(), nodes.ones.to_numpy(), nodes.below.to_numpy())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if len(keys):
                below = batch.column(1).flatten().to_numpy().reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top.log10(keys, below))], names=["key", "value"])

    values = settle(tree.filter("part = 0").select("key", "values").mapInArrow(finish, "key long, value double"), "gram-values")
    needed = in_blocks.select("block", "key").join(values, "key").select("block", "key", "value", F.lit(False).alias("first"))
    words = texts.mapInArrow(_count_words, "block long, key long, n long")
    # A word has a row per block, so summing over them is never a hot group.
    same = W.partitionBy("key")
    needed = needed.union(words.select("block", "key", F.sum("n").over(same).cast("double").alias("value"),
                                       (F.row_number().over(same.orderBy("block")) == 1).alias("first")))
    judged = blocked.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(
        _score, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, logs double, score double, distinct long")
    judged = settle(judged, "scores")
    totals = judged.agg(F.coalesce(F.sum(F.when(F.col("train"), F.col("n_tokens"))), F.lit(0)).alias("train_tokens"), F.sum("distinct").alias("v"))
    scale = F.log10(F.col("train_tokens") + 0.1 * (F.col("v") + 1))
    return judged.crossJoin(F.broadcast(totals)).select("doc_id", "train", "n_tokens", "n_known", "train_tokens", (F.col("logs") - F.col("n_tokens") * scale).alias("base_score"), "score")
