"""Personal data by weak supervision.

Base spans are fixed rules (``base_spans``). Looser candidates - masked addresses,
numbers without a country code, cards with other separators, long network addresses -
join them. Labelers of three sorts vote on every candidate: patterns and checksums,
gazetteers of prefixes and endings, and words of the context. Expectation-maximisation
over the counts of all vote patterns estimates each labeler's hit and false-alarm rate
per kind without any labelled row; its posteriors then train a logistic span classifier
on shape and context features, which decides about the candidates that are not base
spans. Base spans always stay.

Vote patterns and features are small categories, so one count per category is all that
is ever gathered, however large the corpus is. Null texts count as empty. Without
candidates nothing is added. Repeated rows are judged alike; offsets are code points with
an exclusive end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's number, end

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_ZONE = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MASKED_AT = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
MASKED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{2,63})+")
LOOSE_PHONE = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
LOOSE_CARD = re.compile(r"[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])")
LONG_IP = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")

# Endings and prefixes that real addresses and numbers have, and words that speak for or against a kind.
ENDINGS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be se no dk fi pl pt ru cn jp in br ca au".split())
RESERVED = ("0.", "127.", "255.", "224.", "240.")
CARD_PREFIXES = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65", "35", "22", "36", "38")
FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|adresse)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|debit|payment|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|invoice|serial|sha|hash|page|chapter|section|article|figure|table|id)\b")
CONTEXT = 32
LABELERS = 5
THRESHOLD = 0.5


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_octet(part: str) -> bool:
    plain = part.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, 0, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by start and kind."""
    spans = list(_emails(text))
    for zone in IP_ZONE.finditer(text):
        if zone.end() - zone.start() >= 7:
            spans += [(m.start(), 1, m.end()) for m in IP.finditer(text, zone.start(), zone.end())
                      if all(map(_is_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and passes_luhn(d):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans)


def _loose_spans(text: str) -> Iterator[Span]:
    for m in MASKED_AT.finditer(text):
        stop = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        start = stop
        while start > 0 and stop - start < 64 and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < stop and (d := MASKED_DOMAIN.match(text, m.end())):
            yield start, 0, d.end()
    if text.count(":") >= 7:
        yield from ((m.start(), 1, m.end()) for m in LONG_IP.finditer(text))
    yield from ((m.start(), 2, m.end()) for m in LOOSE_CARD.finditer(text))
    yield from ((m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(text))


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that neither overlap a base span nor each other nor stand inside a longer word or number."""
    taken = sorted((s, e) for s, _, e in base)
    out: list[Span] = []
    for start, kind, end in sorted(_loose_spans(text)):
        if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            continue
        if any(s < end and start < e for s, e in taken) or (out and start < out[-1][2]):
            continue
        out.append((start, kind, end))
    return out


def votes(text: str, span: Span, base: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for personal data, 0 against, 2 for no opinion."""
    start, kind, end = span
    found, before = text[start:end], text[max(0, start - CONTEXT):start]
    digits = _digits(found)
    pattern = 1 if base else 2
    if kind == 0:
        check = 1 if found[0] not in ".-" and ".." not in found else 0
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]+", found.rstrip(")]"))[-1].lower() in ENDINGS else 0
    elif kind == 1:
        check = 2 if ":" in found else int(all(len(p) == 1 or p[0] != "0" for p in found.split(".")))
        gazetteer = 0 if found.startswith(RESERVED) else 2
    elif kind == 2:
        check, gazetteer = int(passes_luhn(digits)), int(digits.startswith(CARD_PREFIXES))
    else:
        check = int(len(set(digits)) > 2)
        gazetteer = 1 if found[0] == "+" else int(digits[0] not in "01" and digits[3] not in "01")
    context = 1 if FOR[KINDS[kind]].search(before) else 0 if AGAINST.search(before) else 2
    edges = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    shape = 0 if any(c.isalnum() or c in "_/#=" for c in edges) else 1
    return pattern, check, gazetteer, context, shape


def _category(text: str, span: Span, base: bool) -> str:
    """Kind, votes and the shape features, as one small key."""
    start, kind, end = span
    found = text[start:end]
    after = text[end:end + CONTEXT]
    shape = (min(len(_digits(found)), 20) // 4, int(" " in found), int("-" in found), int("." in found), int("(" in found),
             int(bool(AGAINST.search(after))))
    return f"{kind}|{''.join(map(str, votes(text, span, base)))}|{''.join(map(str, shape))}"


def _candidates(text: str) -> Iterator[tuple[Span, bool]]:
    base = base_spans(text)
    yield from ((s, True) for s in base)
    yield from ((s, False) for s in loose_spans(text, base))


def categories(docs: DataFrame, text: str = "text") -> DataFrame:
    """category and n: how often each combination of kind, votes and shape occurs in all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(_category(t, s, base) for s, base in _candidates(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["category", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(scan, "category string, n long").groupBy("category").agg(F.sum("n").alias("n"))


def reliabilities(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of 0, 1, 2): the share of personal data,
    the rates [personal or not, labeler, vote] with one pseudo-count each, and the posteriors."""
    ballots = np.stack([patterns == v for v in (0, 1, 2)], axis=2).astype(float)
    opinions = (patterns != 2).sum(axis=1)
    posterior = ((patterns == 1).sum(axis=1) + 0.5) / (opinions + 1.0)
    prior, rates = 0.5, np.full((2, patterns.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        share = np.stack([1 - posterior, posterior]) * weights
        prior = (share[1].sum() + 1) / (weights.sum() + 2)
        rates = np.einsum("cp,plv->clv", share, ballots) + np.array([[1.2, 0.8, 1.0], [0.8, 1.2, 1.0]])[:, None, :]
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->cp", ballots, np.log(rates)) + np.log([[1 - prior], [prior]])
        following = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done = np.abs(following - posterior).max(initial=0) < tolerance
        posterior = following
        if done:
            break
    return prior, rates, posterior


def _features(category: str) -> np.ndarray:
    kind, vote, shape = category.split("|")
    ballots = [float(v == w) for v in vote[1:] for w in "01"]
    return np.array([1.0, *(float(int(kind) == k) for k in range(len(KINDS))), *ballots, *map(float, shape)])


@dataclass(frozen=True)
class Classifier:
    """Decides about candidates; ``weights`` is None if there was nothing to learn from."""

    weights: np.ndarray | None
    rates: dict[str, np.ndarray]

    def probability(self, category: str) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_features(category) @ self.weights, -700, 700))))


def train(counts: dict[str, int], rounds: int = 50, penalty: float = 1.0) -> Classifier:
    """EM per kind, then logistic regression (Newton steps, ridge penalty) on its posteriors."""
    if not counts:
        return Classifier(None, {})
    names = sorted(counts)
    n = np.array([counts[c] for c in names], float)
    target, rates = np.zeros(len(names)), {}
    for k, kind in enumerate(KINDS):
        of = [i for i, c in enumerate(names) if c[0] == str(k)]
        if of:
            patterns = np.array([[int(v) for v in names[i].split("|")[1]] for i in of])
            _, rates[kind], target[of] = reliabilities(patterns, n[of])
    x = np.stack([_features(c) for c in names])
    weights = np.zeros(x.shape[1])
    # Frequent categories weigh by the root of their count, so that rare shapes still speak.
    n = np.sqrt(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + penalty * np.eye(len(weights)), x.T @ (n * (target - p)) - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(weights, rates)


def learn(docs: DataFrame, text: str = "text") -> Classifier:
    """The classifier of a corpus; only the count of each category reaches the driver."""
    return train({r.category: r.n for r in categories(docs, text).collect()})


def all_spans(text: str, classifier: Classifier, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by start and kind."""
    base = base_spans(text)
    added = [s for s in loose_spans(text, base) if classifier.probability(_category(text, s, False)) >= threshold]
    return base, sorted(base + added)


def find(docs: DataFrame, classifier: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base and spans: arrays of (kind, start, end) by start and kind."""
    kept = docs.drop("base", "spans")
    at = kept.columns.index(text)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("base", span), T.StructField("spans", span)])

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", classifier, threshold) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rows(b) for b, _ in found], kind), pa.array([rows(a) for _, a in found], kind)],
                                             names=[*batch.schema.names, "base", "spans"])

    return kept.mapInArrow(scan, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are one, named by the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, classifier: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kinds in brackets; null texts stay null."""
    at, schema = docs.columns.index(text), docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and masked(t, all_spans(t, classifier, threshold)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(scan, schema)


def digest(spans: str) -> Column:
    """Spans of an array column as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
