"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1. A trigram is bound from its letters:
the first vector rotated twice, times the second rotated once, times the third. A
text, and likewise all training texts of a language, is the bundle (sum) of its
trigram vectors; the language whose bundle has the largest cosine with the text wins.

Trigrams have a letter in the middle and a letter or a word edge on each side.
Texts are lower-cased. Null texts and texts without a letter are ``und`` with score
0, as is every text when there is nothing to learn from. Ties go to the language
name that sorts first. Repeated rows are judged alike. Columns named as the results
are replaced; all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
SLICE_CHARS = 500_000  # texts are worked on in slices of about so many characters
GRAMS_AT_ONCE = 8192
BOUND_AT_ONCE = 1024  # trigrams bound at once; their letters' vectors stand beside the result
UNDETERMINED = "und"


@dataclass(frozen=True)
class Profiles:
    """One prototype of unit length per language, in order of the names."""

    languages: tuple[str, ...]
    vectors: np.ndarray


_letter_table: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter_table


def letter_vectors(code_points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1/-1 vector of each code point, from a mixing hash of code point and word number."""
    words = dimensions // 64
    x = code_points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x51ED)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(code_points), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


class Trigrams:
    """The trigrams of a slice of texts: a dense number for each, and the numbers of each text."""

    def __init__(self, texts: list[str], dimensions: int = DIMENSIONS) -> None:
        lowered = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64)
        points = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_is_letter()[points], points, np.uint32(32))
        self.alphabet = np.flatnonzero(np.bincount(points, minlength=33))
        if not len(self.alphabet) or self.alphabet[0] != 32:
            self.alphabet = np.union1d(self.alphabet, [32])
        size = len(self.alphabet)
        number = np.zeros(int(self.alphabet[-1]) + 1, np.int64)
        number[self.alphabet] = np.arange(size)
        letters = number[points]  # 0 is the word edge
        middle = np.flatnonzero(letters)
        # The slice ends with an edge; its first letter has none before it.
        before = np.where(middle > 0, letters[middle - 1], 0)
        codes = (before * size + letters[middle]) * size + letters[middle + 1]
        if size**3 <= 1 << 22:
            self.codes = np.flatnonzero(np.bincount(codes, minlength=1))
            dense = np.zeros(size**3, np.int32)
            dense[self.codes] = np.arange(len(self.codes))
            self.numbers = dense[codes]
        else:
            self.codes, self.numbers = np.unique(codes, return_inverse=True)
        if not len(codes):
            self.codes = self.codes[:0]
        self.bounds = np.searchsorted(middle, np.concatenate(([0], ends)))
        self._rows = [np.roll(letter_vectors(self.alphabet, dimensions), turn, axis=1) for turn in (2, 1, 0)]
        self._dimensions = dimensions
        self._all = self._bind(np.arange(len(self.codes))) if len(self.codes) <= 2 * GRAMS_AT_ONCE else None

    def _bind(self, numbers: np.ndarray) -> np.ndarray:
        size = len(self.alphabet)
        first, rest = np.divmod(self.codes[numbers], size * size)
        second, third = np.divmod(rest, size)
        bound = np.empty((len(numbers), self._dimensions), np.float32)
        for at in range(0, len(numbers), BOUND_AT_ONCE):
            part = slice(at, at + BOUND_AT_ONCE)
            bound[part] = self._rows[0][first[part]] * self._rows[1][second[part]] * self._rows[2][third[part]]
        return bound

    def bundle(self, numbers: np.ndarray) -> np.ndarray:
        """The sum of the vectors of these trigrams."""
        if len(self.codes) <= 1 << 15:
            counts = np.bincount(numbers, minlength=1)
            found = np.flatnonzero(counts)
            counts = counts[found]
        else:
            found, counts = np.unique(numbers, return_counts=True)
        total = np.zeros(self._dimensions, np.float64)
        for at in range(0, len(found), GRAMS_AT_ONCE):
            part = found[at:at + GRAMS_AT_ONCE]
            vectors = self._all[part] if self._all is not None else self._bind(part)
            total += counts[at:at + GRAMS_AT_ONCE].astype(np.float32) @ vectors
        return total

    def of(self, text: int) -> np.ndarray:
        return self.numbers[self.bounds[text]:self.bounds[text + 1]]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > SLICE_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text) + 1
    if texts:
        yield start, len(texts)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Bundle the prototypes of all languages from every row with a text and a language.

    Each task bundles what it reads, so a row per task and language is summed;
    only the prototypes reach the driver.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            names = list(sums)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))],
                                              names=["language", "vector"])

        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in _slices(texts):
                grams = Trigrams(texts[start:end])
                of: dict[str, list[np.ndarray]] = {}
                for i in range(start, end):
                    of.setdefault(names[i], []).append(grams.of(i - start))
                for name, parts in of.items():
                    sums[name] = sums.get(name, 0) + grams.bundle(np.concatenate(parts))
            if len(sums) > 1000:
                yield rows()
                sums = {}
        if sums:
            yield rows()

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("language")).filter("text is not null and language is not null")
    parts = known.mapInArrow(bundle, "language string, vector array<double>")
    sums = parts.select("language", F.posexplode("vector").alias("at", "x")).groupBy("language", "at").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("language", "v.x").collect()
    found = {r.language: np.array(r.x) for r in rows}
    found = {name: v / n for name, v in sorted(found.items()) if (n := np.linalg.norm(v))}
    return Profiles(tuple(found), np.array(list(found.values())).reshape(len(found), DIMENSIONS))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``, the cosine with the winning prototype (0 if negative)."""
    kept = docs.drop(pred, score)
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for start, end in _slices(texts) if profiles.languages else ():
                grams = Trigrams(texts[start:end])
                for i in range(start, end):
                    if len(numbers := grams.of(i - start)):
                        vector = grams.bundle(numbers)
                        cosines = profiles.vectors @ vector / max(np.linalg.norm(vector), 1e-300)
                        best = int(np.argmax(cosines))
                        names[i], scores[i] = profiles.languages[best], min(max(float(cosines[best]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, pred, score])

    return kept.mapInArrow(judge, schema)
