"""Spelling variants by k-d trees over letter-count vectors.

Words are the runs of ``[A-Za-z\\u00C0-\\u00FF]`` of all texts, A-Z lower-cased. Two words are near when they
differ by exactly one inserted, deleted or replaced letter. Such words have letter counts at an L1 distance
of two at most: a replacement takes one from a letter and adds one to another, an insertion adds one.

Every length has a k-d tree over the letter counts of its words, fitted on a bounded sample; its leaves are the
boxes in which words are compared. A word stands in one box of its own length and is sent as a query to
every box of its length that one letter less and one letter more can reach, and to every box of the next
length that one letter more can reach (box pruning). A box with more than ``HOME`` words is cut into blocks, each of
which gets all queries, so the sample decides only how even the boxes are, never what is found. In a box the search
goes on down a tree of its own over the distinct vectors; where two vectors differ by the right
letters, the order of letters is verified by looking up each word that the edit can make, so
words that share their letters are never compared with each other.

Each word's form is its near word of largest count, if that is at least ``ratio`` times its own; forms are
followed to the last by pointer doubling. Counts grow along forms, so there are no cycles.

The fixed misprints of the contract (``misprint``) depend on the id and the run; a null id counts as empty text. Null and empty texts have no
words, texts and words may be of any length, repeated rows count again, extra columns are not read, and an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchlake.llm.common import LOWER, settle

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
SAMPLE = 65_536  # words the trees are fitted on
LEAF = 512  # words a box should hold
LEAF_SAMPLE = 16  # words of the sample a box must hold
HOME = 20_000  # words of one block
BUCKET = 24  # vectors compared at once
HELD = 200_000  # words a task counts before it hands them on
ROUTED = 16_384  # words sent to their boxes at once
ACCENTED = range(0xC0, 0x100)
_TABLE = np.zeros(256, np.int64)
_TABLE[[*range(97, 123), *ACCENTED]] = np.arange(26 + len(ACCENTED))
_LETTERS = [chr(c) for c in [*range(97, 123), *ACCENTED]]
NONE = -2  # a move that the search may not make
OPEN = -1  # a move that is still to be made


def misprint(doc_id: object, run: str, start: int | None = None) -> str:
    """The run without one letter, if 199 divides the checksum of id and run."""
    h = crc32(run.encode(), crc32(f"{'' if doc_id is None else doc_id}:".encode()) if start is None else start)
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of ``letters`` letters and ``least`` occurrences or more."""
    # A misprint only shortens, so shorter runs need not be looked at.
    runs = re.compile(f"[a-zA-ZÀ-ÿ]{{{letters},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = crc32(f"{'' if name is None else name}:".encode())
                for run, times in Counter(runs(value.encode().translate(LOWER).decode())).items():
                    word = misprint(name, run, start)
                    if len(word) >= letters:
                        held[word] += times
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text))
    counted = rows.mapInArrow(count, "word string, n long")
    return settle(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "spelling-words")


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return np.bincount(np.repeat(np.arange(len(words)) * len(_LETTERS), lengths) + _TABLE[codes], minlength=len(words) * len(_LETTERS)).reshape(len(words), -1).astype(np.int32)


class Tree:
    """A k-d tree: an inner node is (letter, most, left, right), a leaf is its number."""

    def __init__(self, points: np.ndarray, fits: Callable[[int], bool]) -> None:
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), fits)

    def _grow(self, points: np.ndarray, rows: np.ndarray, fits: Callable[[int], bool]) -> tuple | int:
        if not fits(len(rows)):
            here = points[rows]
            letter = int(np.argmax(here.var(axis=0)))
            values = here[:, letter]
            most = int(np.median(values))
            most -= most == values.max()
            left = values <= most
            if left.any() and not left.all():
                return letter, most, self._grow(points, rows[left], fits), self._grow(points, rows[~left], fits)
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        out = np.zeros(len(points), np.int32)
        for leaf, rows in self._walk(self.root, points, np.arange(len(points)), NONE, NONE):
            out[rows] = leaf
        return out

    def reach(self, points: np.ndarray, shorter: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points whose edit can reach it); pieces of one leaf may come more than once.

        One letter is added; unless ``shorter``, a letter before it in the alphabet is taken away.
        """
        return self._walk(self.root, points, np.arange(len(points)), OPEN, NONE if shorter else OPEN)

    def _walk(self, node: tuple | int, points: np.ndarray, rows: np.ndarray, added: int, taken: int) -> Iterator[tuple[int, np.ndarray]]:
        if not len(rows) or (added >= 0 and taken > added):
            return
        if isinstance(node, int):
            yield node, rows
            return
        letter, most, left, right = node
        values = points[:, letter]
        low = values <= most
        yield from self._walk(left, points[low], rows[low], added, taken)
        yield from self._walk(right, points[~low], rows[~low], added, taken)
        for move, step, open_, side in ((1, values == most, added, right), (-1, values == most + 1, taken, left)):
            if open_ == OPEN and step.any():
                moved = points[step]
                moved[:, letter] += move
                yield from self._walk(side, moved, rows[step], *((letter, taken) if move > 0 else (added, letter)))


def fit(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, leaf_sample: int = LEAF_SAMPLE) -> dict[int, Tree]:
    """A tree per length, from at most ``sample`` words; lengths without words in it have one box."""
    total = words.count()
    share = min(1.0, sample / max(total, 1))
    drawn = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).toArrow().column(0).to_pylist()
    least = max(1, leaf_sample if share < 1 else 1, int(leaf * share))
    by_length = defaultdict(list)
    for word in drawn:
        by_length[len(word)].append(word)
    return {length: Tree(vectors(group), lambda n: n <= least) for length, group in by_length.items()}


def _route(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """length, leaf, role (0: stands there, 1: query of that length, 2: shorter query), word and n."""
    shared = words.sparkSession.sparkContext.broadcast({length: tree.root for length, tree in trees.items()})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = shared.value

        def tree(length: int) -> Tree:
            out = Tree.__new__(Tree)
            out.root = roots.get(length, 0)
            return out

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            names, ns = table.column(0).to_pylist(), table.column(1).to_numpy()
            lengths = np.fromiter(map(len, names), np.int64, len(names))
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                points = vectors([names[i] for i in rows])
                own, longer = tree(length), tree(length + 1)
                pieces = [(length, own.homes(points), np.arange(len(rows)), 0)]
                pieces += [(length, leaf, at, 1) for leaf, at in own.reach(points, False)]
                pieces += [(length + 1, leaf, at, 2) for leaf, at in longer.reach(points, True)]
                leaves = np.concatenate([np.broadcast_to(leaf, len(at)) for _, leaf, at, _ in pieces]).astype(np.int32)
                targets = np.concatenate([np.full(len(at), t, np.int32) for t, _, at, _ in pieces])
                roles = np.concatenate([np.full(len(at), r, np.int32) for _, _, at, r in pieces])
                at = np.concatenate([at for _, _, at, _ in pieces])
                # A leaf may be reached in several ways.
                first = np.unique(np.stack([roles, leaves, at.astype(np.int32)]), axis=1, return_index=True)[1]
                chosen = rows[at[first]]
                yield pa.RecordBatch.from_arrays([pa.array(targets[first]), pa.array(leaves[first]), pa.array(roles[first]),
                                                  pa.array([names[i] for i in chosen], pa.string()), pa.array(ns[chosen])], names=["length", "leaf", "role", "word", "n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROUTED:
                yield from sent(pa.Table.from_batches(held))
                held = []
        if held:
            yield from sent(pa.Table.from_batches(held))

    return words.select("word", "n").mapInArrow(route, "length int, leaf int, role int, word string, n long")


class Box:
    """The words of one block, to be searched by queries of the same or the next shorter length."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.counts = dict(zip(words, counts))
        points, self.of = np.unique(vectors(words), axis=0, return_inverse=True)
        self.points, self.tree = points, Tree(points, lambda n: n <= BUCKET)

    def near(self, words: list[str], shorter: bool) -> Iterator[tuple[int, str]]:
        """(query, word of the box) for every near pair; a replaced letter comes before the one put in its place."""
        queries = vectors(words)
        wanted = 1 if shorter else 2
        for leaf, rows in self.tree.reach(queries, shorter):
            points = self.points[self.tree.leaves[leaf]]
            letters = np.flatnonzero(points.any(axis=0) | queries[rows].any(axis=0))
            points, asked = points[:, letters], queries[rows][:, letters]
            block = max(1, (1 << 22) // points.size)
            for at in range(0, len(rows), block):
                difference = points[None, :, :] - asked[at:at + block, None, :]
                for q, p in zip(*np.nonzero(np.abs(difference).sum(axis=2) == wanted)):
                    yield from self._verified(int(rows[at + q]), words[rows[at + q]], difference[q, p], letters)

    def _verified(self, query: int, word: str, difference: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, str]]:
        put = letters[difference.argmax()]
        new = _LETTERS[put]
        if len(taken := np.flatnonzero(difference < 0)):
            if letters[taken[0]] > put:
                return
            old = _LETTERS[letters[taken[0]]]
            made = {word[:i] + new + word[i + 1:] for i, c in enumerate(word) if c == old}
        else:
            made = {word[:i] + new + word[i:] for i in range(len(word) + 1)}
        yield from ((query, m) for m in made if m in self.counts)


def near_pairs(words: DataFrame, home: int = HOME, **fitting: int) -> DataFrame:
    """a, an, b and bn: every pair of near words once, with their counts. ``words`` has word and n and is written."""
    routed = settle(_route(words, fit(words, **fitting)), "spelling-boxes")
    blocks = routed.filter("role = 0").groupBy("length", "leaf").agg(F.ceil(F.count("*") / home).cast("int").alias("blocks"))
    placed = routed.join(blocks, ["length", "leaf"]).withColumn("block", F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("blocks") - 1)))).drop("blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, standing, counts, box = None, [], [], None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            names, ns = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            changes = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
            out: list[tuple[str, int, str, int]] = []
            for first, last in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
                if first == last:
                    continue
                *at, role = (int(c[first]) for c in columns)
                if at != key:
                    key, standing, counts, box = at, [], [], None
                if role == 0:
                    standing += names[first:last]
                    counts += ns[first:last]
                    continue
                box = box or Box(standing, counts)
                # Words of equal letters ask the tree once each: their order differs, and so does what an edit makes of them.
                out += [(names[first + q], ns[first + q], near, box.counts[near]) for q, near in box.near(names[first:last], role == 2)]
            a, an, b, bn = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(an, pa.int64()), pa.array(b, pa.string()), pa.array(bn, pa.int64())], names=["a", "an", "b", "bn"])

    key = ["length", "leaf", "block"]
    boxed = placed.select(*key, "role", "word", "n").repartition(*key).sortWithinPartitions(*key, "role")
    return settle(boxed.mapInArrow(search, "a string, an long, b string, bn long"), "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words of ``forms`` (word, form): pointers double until none goes on."""
    steps = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = settle(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        steps = following.drop("moved")
        if following.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, **search: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = word_counts(docs, doc_id, text, letters, least)
    pairs = near_pairs(words, **search)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    strong = F.col("form_n") >= F.col("n") * ratio
    known = settle(joined.select("word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(strong, F.col("form_n")).alias("form_n")), "spelling-forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
