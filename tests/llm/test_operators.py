"""The training-text operators against brute force, on fixtures with nulls, empty texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from launchlake.llm import (chat_view, common, decontaminate, language_id, lm_scoring, neighbours, packing, pii, repeats, simhash, token_file,
                            tokens, tool_calls)
from launchlake.session import scratch_dir

LETTERS = {"en": "the of and ing tion er", "de": "der ung keit sch ein lich", "es": "cion ado que os mente"}
DOCS = "doc_id long, text string, lang string, source string, score string, key long, fp long, block int"


def prose(rng, lang, words):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


def corpus(seed=5, n=80):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        rows.append((i, prose(rng, lang, rng.randint(1, 120)), lang))
    shared = prose(rng, "en", 60)
    rows += [(n, shared, "en"), (n + 1, "One " + shared + " more", "en"), (n + 2, prose(rng, "de", 50) + " " + shared, "de"), (n + 3, shared, "en")]
    rows += [(n + 4, None, "en"), (n + 5, "", None), (n + 6, " \t\n", "es"), (n + 7, "12 34 !!", "en"), (n + 8, "Café ÉTÉ \U0001f600 中文", "fr"),
             (n + 9, "be " * 90, "en"), (n + 9, "be " * 90, "en"), (None, "no id at all", "en"), (n + 10, "x" * 30_000, None), (n + 11, "word " * 5000, "en")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "clash", 1, 2, 3) for r in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(common.LOWER) if lower else raw).split()


# --- language identification -------------------------------------------------------------------------------------------

def bundle(text, dimensions=language_id.DIMENSIONS):
    """A text's bundle, letter by letter."""
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    vector = {c: language_id.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in set(letters)}
    total = np.zeros(dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b != " ":
            total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return total


def test_language_matches_letter_by_letter_profiles(docs, rows):
    profiles = language_id.learn(docs)
    sums = {}
    for _, text, lang in rows:
        if text and lang:
            sums[lang] = sums.get(lang, 0) + bundle(text)
    names = sorted(n for n, v in sums.items() if np.linalg.norm(v))
    assert list(profiles.languages) == names
    want = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    assert np.allclose(profiles.vectors, want, atol=1e-9)
    judged = language_id.predict(docs, profiles)
    assert judged.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    for r in judged.collect():
        vector = bundle(r.text or "")
        if not np.linalg.norm(vector):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            cosines = want @ vector / np.linalg.norm(vector)
            assert r.score == pytest.approx(max(cosines.max(), 0), abs=1e-5)
            assert cosines[names.index(r.lang_pred)] == pytest.approx(cosines.max(), abs=1e-5)


def test_language_of_unseen_texts_and_without_profiles(spark, docs, nothing):
    profiles = language_id.learn(docs)
    rng = random.Random(99)
    fresh = [(i, prose(rng, lang, 30), lang) for i, lang in enumerate(list(LETTERS) * 20)]
    judged = language_id.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), profiles).collect()
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)
    empty = language_id.learn(nothing)
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, empty).collect()} == {("und", 0.0)}
    assert language_id.predict(nothing, profiles).count() == 0
    odd = language_id.Trigrams(["".join(map(chr, range(0x4E00, 0x4E00 + 40_000 - 20_000)))])
    assert np.linalg.norm(odd.bundle(odd.of(0))) > 0


# --- near duplicates ---------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    import xxhash
    tokens_ = words_of(text, lower=True)
    shingles = [b" ".join(tokens_[i:i + 3]) for i in range(max(1, len(tokens_) - 2))] if tokens_ else []
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


def slow_components(prints):
    """Smallest id of the component of each (id, fingerprint)."""
    distinct = sorted(set(prints.values()))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            up[root(a)] = root(b)
    least = {}
    for i, f in prints.items():
        if isinstance(i, int):
            least[root(f)] = min(least.get(root(f), i), i)
    return {i: least.get(root(f)) for i, f in prints.items()}


def test_near_duplicates_match_all_pairs(docs, rows, nothing):
    want = {i: slow_fingerprint(t) for i, t, _ in rows}
    groups = slow_components(want)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{want[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("crowd", [64, 3])
def test_crowded_blocks_lose_no_link(spark, crowd):
    rng = random.Random(3)
    prints = {}
    for group in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            prints[len(prints)] = f
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints.items()]
    got = simhash.components(spark, spark.createDataFrame(signed, "doc_id long, fp long"), crowd=crowd).collect()
    assert {r.doc_id: r.component_id for r in got} == slow_components(prints)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.node: r.component for r in common.connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


# --- repeated passages -------------------------------------------------------------------------------------------------

def slow_kept(rows, size=35):
    seen = Counter(tuple(w[i:i + size]) for _, t, *_ in rows for w in [words_of(t)] for i in range(len(w) - size + 1))
    out = []
    for doc, text, *_ in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if seen[tuple(words[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((doc, b" ".join(kept).decode(), len(words), len(words) - len(kept)))
    return sorted(out, key=str)


def test_repeats_match_all_windows(docs, rows, nothing):
    got = sorted(map(tuple, repeats.remove(docs).collect()), key=str)
    assert got == slow_kept(rows)
    assert repeats.remove(nothing).count() == 0


def test_branching_repeats_and_segments(spark, monkeypatch):
    rng = random.Random(8)
    a, b, c = ([f"{x}{rng.randrange(9)}" for _ in range(70)] for x in "abc")
    texts = [a + b, b + c, a[30:] + c[:40], c[20:] + b[:50] + a[:34], a[:35], (a + b + c) * 3, list("xyz") * 40, a[:20] + b[:34]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.remove(docs).collect()), key=str) == slow_kept(rows)
    words = repeats.Words(" ".join(a + b + c))
    whole = [(at + i, m) for at, n, m, _ in repeats.paths(words, 35, 8) for i in range(n)]
    monkeypatch.setattr(repeats, "SEGMENT", 50)
    cut = [(at + i, m) for at, n, m, _ in repeats.paths(words, 35, 8) for i in range(n)]
    assert [w for w, _ in whole] == list(range(len(words.words) - 34)) and whole == cut


# --- language model ----------------------------------------------------------------------------------------------------

def slow_ctw(train, texts, depth=lm_scoring.DEPTH):
    """Context-tree weighting node by node: log10 probability of each text."""
    counts, kids = {}, {}

    def decisions(text):
        data = b"\xff" * depth + text + b"\xff"
        for at in range(depth, len(data)):
            for k in range(8):
                yield data[at - depth:at], (1 << k) | data[at] >> (8 - k), data[at] >> (7 - k) & 1

    for known, group in ((True, train), (False, texts)):
        for text in group:
            for context, node, bit in decisions(text):
                for d in range(depth + 1):
                    key = context[depth - d:], node
                    counts.setdefault(key, [0, 0])[bit] += known
                    if d:
                        kids.setdefault((context[depth - d + 1:], node), set()).add(key)

    def kt(key):
        a, b = counts[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    mixed, own = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        if len(key[0]) == depth:
            mixed[key], own[key] = kt(key), 1.0
        else:
            below = sum(mixed[k] for k in kids[key])
            mixed[key] = np.logaddexp(kt(key), below) - math.log(2)
            own[key] = 1 / (1 + math.exp(min(700, below - kt(key))))
    out = []
    for text in texts:
        total = 0.0
        for context, node, bit in decisions(text):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                key = context[depth - d:], node
                a, b = counts[key]
                p += rest * own[key] * ([a, b][bit] + .5) / (a + b + 1)
                rest *= 1 - own[key]
            total += math.log10(p)
        out.append(total)
    return out


def test_context_tree_scores_match_node_by_node(spark, rows, docs, nothing):
    from pyspark.sql import functions as F
    small = [(i, t) for i, t, _ in rows if len(t or "") < 700]
    frame = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    got = lm_scoring.score(frame, F.col("doc_id") % 5 != 0).collect()
    lowered = {i: (t or "").encode().translate(common.LOWER) for i, t in small}
    learns = {i: i is not None and i % 5 != 0 for i, _ in small}
    train = [t for i, t in [(i, (t or "").encode().translate(common.LOWER)) for i, t in small] if learns[i]]
    want = dict(zip(lowered, slow_ctw(train, list(lowered.values()))))
    counts = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(small)
    for r in got:
        own = [*lowered[r.doc_id].split(), b""]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (learns[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in own))
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
    assert lm_scoring.score(nothing, F.lit(True)).count() == 0
    untrained = lm_scoring.score(frame, F.lit(False)).collect()
    assert all(r.score == pytest.approx((len(lowered[r.doc_id]) + 1) * 8 * math.log10(.5)) for r in untrained)


def test_probabilities_of_all_next_bytes_add_up():
    gram = np.array([(0x616263 << 24 | 0x6465 << 8 | b) for b in range(256)], np.int64)
    below, level = lm_scoring.subtrees(gram, np.where(np.arange(256) % 7 == 0, 5, 0))
    top = lm_scoring.Top(level.keys & 0xFFFFFF, level.zeros, level.ones, level.mixed)
    assert (10 ** top.log10(gram, below)).sum() == pytest.approx(1.0)


# --- tokens, packing and files -----------------------------------------------------------------------------------------

TOKENIZER = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)


def slow_ids(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_word_by_word_ids_are_the_tokenizers(monkeypatch):
    rng = random.Random(2)
    signs = "aAbÉßẞİıK'.,!?- \t\n\x0b\x1c\x85 éΣσς012½一한가<|>\U0001f600stredm"
    encoder = tokens.Encoder(tokens.DEFAULT_TOKENIZER)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 50)
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 50))) + rng.choice(["", " <|endoftext|>x", "<|STARTOFTEXT|>"]) for _ in range(400)]
    for at in range(0, 400, 20):
        part = [*texts[at:at + 20], None]
        assert encoder.encode(part) == [slow_ids(t)[:-1].tobytes() for t in part]


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_is_whole_gapless_and_tight(docs, rows, nothing, capacity):
    got = packing.pack(packing.pieces(docs, capacity=capacity), capacity=capacity).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = slow_ids(text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.1 * math.ceil(sum(r.length for r in got) / capacity) + 1
    assert packing.pack(packing.pieces(nothing)).count() == 0


def test_packing_rounds_join_what_tasks_leave(spark):
    rng = random.Random(4)
    lengths = [rng.choice([5, 30, 60, 61, 99]) for _ in range(4000)]
    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows, capacity=100, items_per_task=300).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 100 and len(bins) <= 1.05 * len(packing.best_fit(lengths, 100))


def test_token_files_round_trip_and_prune(spark, docs, rows, nothing):
    path = scratch_dir(spark, "orc-test")
    token_file.write(docs, path)
    stored = token_file.read(spark, path).orderBy("seq").collect()
    ids = [r.doc_id for r in stored]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = Counter((i, slow_ids(t).tobytes()) for i, t, _ in rows)
    assert Counter((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in stored) == want
    starts, at = Counter(), 0
    for r in stored:
        starts[r.doc_id, at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())] += 1
        at += len(r.ids)
    assert Counter(map(tuple, token_file.digests(spark, path).collect())) == starts
    found = token_file.lookup(spark, path, [3, 999])
    assert [r.doc_id for r in found.collect()] == [3]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    empty = scratch_dir(spark, "orc-empty")
    token_file.write(nothing, empty)
    assert token_file.digests(spark, empty).count() == 0


# --- personal data -----------------------------------------------------------------------------------------------------

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def slow_spans(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_rules():
    rng = random.Random(6)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@q.r", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
              "+12", "+ 1", " ", ".", "-", "+", "7", "42", "é", "\n", "a", "@b.c", "..", "4556737586899855", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        assert pii.base_spans(text) == slow_spans(text), text
    long = "a" * 200_000 + "1" * 200_000 + "." * 1000 + "+" * 1000 + "- " * 1000
    assert pii.base_spans(long) == []


def test_weak_supervision_adds_masked_data_and_keeps_the_base(spark, nothing):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        card = next(str(c) for c in iter(lambda: rng.randrange(4 * 10**15, 5 * 10**15), None) if pii.passes_luhn(str(c)))
        rows += [(4 * i, f"please mail ann{i}@example.com or call +1 555 {rng.randrange(200, 999)} 01{rng.randrange(10, 99)}"), (4 * i + 1, f"visa card {card} from host 10.2.3.{i % 250}"),
                 (4 * i + 2, f"order 123-456-78{i % 90 + 10} of version 1.2.{i}"), (4 * i + 3, "nothing to see here")]
    extra = [(9001, "mail bob (at) example (dot) com now"), (9002, "call 555-234-5678 today"), (9003, "serial 1234.5678.9012.3456x"), (9004, None), (9005, ""), (9006, "plain prose, 12 of 34")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + extra], "doc_id long, text string, spans string, base int").repartition(4)
    model = pii.learn(docs)
    assert set(model.rates) == {"email", "ip", "card", "phone"}
    found = {r.doc_id: r for r in pii.find(docs, model).collect()}
    for i, text in rows + extra:
        base = slow_spans(text or "")
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in found[i].base] == base
        assert set(base) <= {(s.start, pii.KINDS.index(s.kind), s.end) for s in found[i].spans}
    assert [(s.kind, s.start) for s in found[9001].spans] == [("email", 5)] and [s.kind for s in found[9002].spans] == ["phone"]
    assert not any(found[i].spans for i in (9003, 9004, 9005, 9006)) and not any(found[4 * i + 3].spans for i in range(300))
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[9001] == "mail [EMAIL] now" and clean[9004] is None and clean[9006] == extra[-1][1] and "@" not in clean[0]
    assert pii.learn(nothing).weights is None and pii.find(nothing, pii.learn(nothing)).count() == 0
    assert pii.masked("a+1 555 1234567b", [(1, 3, 15), (4, 2, 15)]) == "a[PHONE]b"


def test_expectation_maximisation_finds_the_liar():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth).astype(int) for right in (0.95, 0.9, 0.85, 0.55)], axis=1)
    votes[rng.random(votes.shape) < 0.1] = 2
    prior, rates, posterior = pii.reliabilities(votes, np.ones(4000))
    assert prior == pytest.approx(0.4, abs=0.05) and ((posterior > 0.5) == truth).mean() > 0.95
    assert rates[1, 0, 1] > rates[1, 3, 1] and rates[0, 0, 0] > rates[0, 3, 0]


# --- nearest neighbours ------------------------------------------------------------------------------------------------

def test_neighbours_are_exact_and_mostly_found(spark):
    rng = np.random.default_rng(2)
    table = rng.standard_normal((3000, 16))
    table[:900] = table[0]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(table)]
    odd = [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [1.0, None] * 8), (None, [1.0] * 16), (3400, [1.0]), (3500, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + odd + rows[5:6], "vec_id long, embedding array<double>")
    got = neighbours.search(frame, lambda i: i % 100 == 0, block=500).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert sorted(found) == list(range(0, 3000, 100))
    hit = 0
    for q, pairs in found.items():
        d = np.sqrt(((table - table[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hit += len({i for i, _ in pairs} & set(order))
        assert all(s == d[i] for i, s in pairs) and len(pairs) == 10
    assert hit >= 0.9 * 300
    few = neighbours.search(spark.createDataFrame(rows[899:903], frame.schema), lambda i: i % 100 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(900, 1), (900, 2), (900, 3)]
    assert neighbours.search(frame.filter("vec_id > 2999"), lambda i: i % 100 == 0).count() == 0


def test_repeated_rows_do_not_push_neighbours_out(spark):
    """Every row three times gives what every row once gives, also where blocks are small."""
    rng = np.random.default_rng(4)
    table = rng.standard_normal((400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(table)]
    frame = spark.createDataFrame(rows * 3 + rows[7:8] * 50, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(neighbours.search(frame, lambda i: i % 100 == 0, block=64, recall=1.0).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 400, 100):
        d = ((table - table[q]) ** 2).sum(axis=1)
        assert len(got[q]) == 10 and len(set(got[q]) & {int(i) for i in np.argsort(d)[1:11]}) >= 9


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_beyond_the_sample_and_the_share_searched(clustered):
    """Four times the sample: recall holds; the share of rows compared falls with the table where vectors have structure."""
    rng = np.random.default_rng(6)
    shares = []
    for n in (4096, 16384):
        centres = rng.standard_normal((64, 24)) * 6
        table = rng.standard_normal((n, 24)) + (centres[rng.integers(0, 64, n)] if clustered else 0)
        sample = table[:4096]
        forest = neighbours.grow(sample, depth=neighbours.deep(n))
        count = neighbours.effort(forest, sample, 10)
        leaves = np.stack([t.file(table) for t in forest])
        hit, seen = 0, 0
        for q in range(0, n, n // 50):
            found = np.zeros(n, bool)
            for t, leaf in neighbours.visits(forest, table[q], count):
                found |= leaves[t] == leaf
            true = np.argsort(((table - table[q]) ** 2).sum(axis=1))[1:11]
            hit += found[true].sum()
            seen += found.sum()
        tried = len(range(0, n, n // 50))
        assert hit >= 0.9 * 10 * tried
        shares.append(seen / n / tried)
    assert shares[1] < (0.25 if clustered else 1) and (not clustered or shares[1] < shares[0])


# --- decontamination ---------------------------------------------------------------------------------------------------



def test_copies_and_changed_parameters_are_found(spark, nothing):
    items = [(1, "A train leaves Berlin at 9 and drives 120 km to Hamburg, so how long does the train from Berlin need at 60 km per hour?"),
             (2, "What is the sum of the first seven odd numbers that come after the largest prime below ten?"), (3, "Too short"), (4, None), (None, "no id for this one at all here"),
             (5, "12 13 14 15 16 17 18"), (2, "What is the sum of the first seven odd numbers that come after the largest prime below ten?")]
    changed = "a train leaves Munich at 7 and drives 300 miles to Dresden, so how long does the train from Munich need at 50 miles per hour?"
    mixed = "a train leaves Munich at 7 and drives 300 miles to Dresden, so how long does the train from Leipzig need at 50 miles per hour?"
    docs = [(1, f"Some words first. {items[0][1]} And some after."), (2, f"before it {changed} after it"), (3, f"before it {mixed} after it"),
            (4, "WHAT IS THE SUM OF THE FIRST SEVEN ODD NUMBERS THAT COME AFTER THE LARGEST PRIME BELOW TEN?"), (5, "what is the sum of the first seven things"), (6, None), (7, ""),
            (8, "12 13 14 15 16 17 18 19"), (9, "Too short"), (10, f"{items[1][1]} {items[0][1]}"), (10, "another text with the same id and no item in it"), (None, items[1][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, key int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.decisions(frame, bench).select("doc_id", "contaminated", "n_items", "exact").collect()), key=str)
    assert got == sorted([(1, True, 1, True), (2, True, 1, False), (3, False, 0, None), (4, True, 1, True), (5, False, 0, None), (6, False, 0, None), (7, False, 0, None),
                          (8, True, 1, True), (9, True, 1, True), (10, True, 2, True), (10, False, 0, None), (None, True, 1, True)], key=str)
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7, 10]
    assert decontaminate.decisions(nothing, bench).count() == 0
    assert decontaminate.clean(frame, bench.limit(0)).count() == len(docs)


def test_a_slot_conflict_costs_only_its_windows(spark):
    item = ("A baker packs 12 rolls into every box and sells each of them at the market early in the morning before school, so with 12 boxes "
            "and 30 guests in the garden how many rolls are left when all of them have had one?")
    texts = {1: item.replace("12 boxes", "13 boxes"), 2: item.replace("30", "12"), 3: item.replace("12 rolls", "14 rolls").replace("12 boxes", "13 boxes"),
             4: item.replace("12", "17").replace("30", "17"), 5: "unrelated words " * 9}
    docs = spark.createDataFrame([(i, f"before it {t} after it") for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.exact, r.coverage) for r in decontaminate.decisions(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    n = len(item.split()) - 4
    assert got == {1: (True, False, (n - 5) / n), 2: (True, False, 1.0), 3: (False, None, None), 4: (True, False, 1.0), 5: (False, None, None)}


def test_slots_and_order_hold_over_all_pieces_of_a_copy(spark):
    """Two words put between the halves change nothing; other values and swapped halves are seen across them."""
    first = "a shop keeps 12 crates of ripe apples near the door and sells some of them every morning before school"
    second = "later another cart brings exactly 12 crates more so how many crates of ripe fruit are there when evening comes"
    texts = {1: f"{first} {second}", 2: f"{first} filler words {second}", 3: f"{first.replace('12', '14')} {second.replace('12', '13')}",
             4: f"{first.replace('12', '14')} filler words {second.replace('12', '13')}", 5: f"{second} {first}", 6: f"{first.replace('12', '9')} filler words {second.replace('12', '9')}",
             7: first, 8: "many words before " * 3000 + f"{first} filler words {second}" + " and many behind" * 3000, 9: f"{first} {second} {first} {second}"}
    docs = spark.createDataFrame([(i, f"before it {t} after it", "x", "y") for i, t in texts.items()], "doc_id long, text string, found string, key string")
    bench = spark.createDataFrame([(1, f"{first} {second}"), (1, f"{first} {second}")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.exact, r.n_items) for r in decontaminate.decisions(docs, bench).collect()}
    assert got == {1: (True, True, 1), 2: (True, False, 1), 3: (False, None, 0), 4: (False, None, 0), 5: (False, None, 0), 6: (True, False, 1), 7: (False, None, 0), 8: (True, False, 1), 9: (True, True, 1)}
    left = decontaminate.clean(docs, bench).collect()
    assert {(r.doc_id, r.found, r.key) for r in left} == {(i, "x", "y") for i in (3, 4, 5, 7)}


def test_items_without_id_or_without_windows(spark):
    items = [(None, "this item has no id but words enough to be found"), (2, "Only four small words"), (3, "two words"), (4, "12 13 14 15 16 17 18"), (5, ""), (6, "!!"), (7, None)]
    docs = [(1, "Now this item has no id but words enough to be found."), (2, "these are only FOUR small words here"), (3, "two words"), (4, "two words more"), (5, "7 12 13 14 15 16 17 18 9"),
            (6, "12 13 14 15 16 17 19"), (7, ""), (8, "!!"), (9, "only four small things")]
    got = {r.doc_id: (r.contaminated, r.item_id, r.exact) for r in decontaminate.decisions(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    clean = (False, None, None)
    assert got == {1: (True, None, True), 2: (True, 2, True), 3: (True, 3, True), 4: clean, 5: (True, 4, True), 6: clean, 7: clean, 8: clean, 9: clean}


def test_spelled_numbers_and_all_names_are_slots(spark):
    item = ("At noon McDonald buys seven ripe apples from a farm near the old harbour. Anna then takes three of these apples home and gives the rest "
            "to NASA before school begins. McDonald keeps one basket, so how many are left?")
    changed = item.replace("seven", "12").replace("three", "four").replace("Anna", "Maria").replace("McDonald", "O").replace("NASA", "ESA").replace("O ", "MacLeod ")
    texts = [(1, changed), (2, item.replace("seven", "twelve")), (3, item.lower()), (4, item.upper()), (5, item.replace("Anna", "Maria")), (6, item.replace("apples", "pears").replace("left", "gone").replace("begins", "ends").replace("farm", "shop"))]
    docs = spark.createDataFrame([(i, f"before it: {t} after it") for i, t in texts], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.exact) for r in decontaminate.decisions(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True), 4: (True, True), 5: (True, False), 6: (False, None)}


def test_coverage_matches_brute_force(spark):
    """On literal text the decision is the share of an item's distinct windows that the document holds."""
    rng = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(3) for j in range(4)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 20)))) for i in range(30)]
    docs = []
    for i in range(120):
        item = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = rng.choice(words)
        docs.append((i, " ".join([*rng.choices(words, k=5), *item, *rng.choices(words, k=5)])))
    shingles = lambda t: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in docs for i, u in items if shingles(u) and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(u)) - 1e-9}
    want |= {(d, i) for d, t in docs for i, u in items if not shingles(u) and f" {u} " in f" {t} "}  # four words
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.found_items(frame, spark.createDataFrame(items, "item_id long, text string"))
    keys = frame.select("doc_id", decontaminate.row_key("doc_id", "text").alias("key"))
    assert {(r.doc_id, r.item) for r in found.join(keys, "key").collect()} == want and want


# --- tool calls --------------------------------------------------------------------------------------------------------

def test_calls_are_linked_ordered_and_checked(spark):
    call = lambda turn, i, name, arguments, *needs: ("c", turn, i, name, arguments, list(needs))
    calls = [call(1, "a", "f", '{"n":1,"s":"x"}'), call(2, "b", "f", '{"s":"x","n":1.5}', "a"), call(3, "c", "f", '{"n":"1"}', "a", "b"), call(4, "d", "g", "[1]", "zz"), call(5, "e", "h", '{"q":1}', "e2"),
             call(6, "e2", "f", None, "e"), call(7, "f", "f", '{"n":2,"s":"y","t":{"b":[1],"a":null}}', "c", "x"), call(9, "x", "f", '{"n":2,"s":"z"}'), call(8, "a", "f", "{}"), call(8, None, "f", "{}"),
             (None, 1, "a", "f", "{}", None), call(10, "y", "f", '{"n":1,"s":"e"}', "e2")]
    results = [("c", 2, "a", "ok"), ("c", 3, "a", "late"), ("c", 1, "b", "early"), ("c", 4, "q", "orphan"), ("d", 1, "a", None)]
    schemas = [("f", "n", "integer", True), ("f", "s", "string", True), ("g", "n", "number", False)]
    make = lambda: tool_calls.link(spark.createDataFrame(calls, "conv_id string, turn int, call_id string, name string, arguments string, needs array<string>"),
                                   spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string"),
                                   spark.createDataFrame(schemas, "name string, parameter string, type string, required boolean"))
    got = {(r.conv_id, r.call_id): r for r in make().collect()}
    assert len(got) == 11
    assert {k[1]: r.level for k, r in got.items() if k[0] == "c" and r.n_calls} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "e2": None, "f": 3, "x": 0, "y": None}
    assert {k[1]: r.status for k, r in got.items() if k[0] == "c"} == {**dict.fromkeys(["c", "d", "e", "e2", "f", "x", "y"], "unanswered"), "a": "linked", "b": "early", "q": "orphan"}
    assert got["c", "a"].line == '{"arguments":{"n":1,"s":"x"},"call_id":"a","content":"ok","errors":[],"level":0,"name":"f","status":"linked"}'
    assert (got["c", "a"].n_calls, got["c", "a"].n_results, got["d", "a"].status) == (2, 2, "orphan")
    assert '"errors":["type:n"]' in got["c", "b"].line and '"errors":["missing:s","type:n"]' in got["c", "c"].line
    assert '"arguments":[1]' in got["c", "d"].line and '"errors":["not_an_object"]' in got["c", "d"].line and got["c", "d"].n_missing == 1
    assert '"errors":["unknown_tool"]' in got["c", "e"].line and '"t":{"a":null,"b":[1]}' in got["c", "f"].line and '"errors":["unknown:t"]' in got["c", "f"].line
    order = [k for _, k in sorted((r.place, k[1]) for k, r in got.items() if k[0] == "c")]
    assert order[:6] == ["a", "d", "x", "b", "c", "f"]


def test_long_chains_take_few_rounds(spark):
    calls = [("c", t, f"k{t}", "f", "{}", [f"k{t - 1}"] if t else []) for t in range(200)]
    got = tool_calls.levels(spark.createDataFrame(calls, "conv_id string, turn int, call_id string, name string, arguments string, needs array<string>")).collect()
    assert {r.call_id: r.level for r in got} == {f"k{t}": t for t in range(200)}


def test_the_view_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link(chat_view.calls(none), chat_view.results(none), chat_view.schemas(spark)).count() == 0


def test_digest_of_spans(spark):
    row = spark.createDataFrame([([("ip", 1, 8), ("card", 9, 20)],), ([],)], "spans array<struct<kind:string,start:int,end:int>>").select(pii.digest("spans").alias("d")).collect()
    assert [r.d for r in row] == ["ip:1:8,card:9:20", ""] and hashlib.sha256(b"").hexdigest().startswith("e3b0")
