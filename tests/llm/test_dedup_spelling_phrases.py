"""Exact dedup, spelling variants and collocations against brute force, on odd, empty and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from launchlake.llm import collocations, common, exact_dedup, spelling

DOCS = "doc_id long, text string, lang string, source string, digest string, salt int, n int, word string, rank int, row int, best int"
ROOTS = "th en er ing ou ar la ción tion ße être".split()


def rows_of():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(ROOTS, k=rng.randint(1, 4)))
    pool = [word() for _ in range(150)]
    text = lambda n: "".join(rng.choice(pool if rng.random() < 0.8 else [word()]).capitalize() + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 150)), rng.choice(["en", "de", None])) for i in range(120)]
    rows += [(200 + i, rows[i % 4][1].replace(" ", " " * (1 + i % 3)), "en") for i in range(60)]  # white space apart, equal
    rows += [(300, None, "en"), (301, "", "de"), (302, " \t\n\v\f\r", None), (303, None, None), (304, "a", "en"), (305, "a ", "en"), (306, "A", "en")]
    rows += [(5, "twice", "en"), (5, "twice", "en"), (None, "twice", "en"), (4, "tw ice", "xx"), (3, "tw ice", "xx")]
    rows += [(None, "no id", "en"), (None, "no id", "en"), (400, "x" * 30_000, "en"), (401, "Äther Äther äther " * 2000, "de"), (402, "of the of the; of the " * 800, "zz")]
    rows += [(403, "therlaing " * 300 + "therlaang " * 40 + "thelaang " * 6 + "therlains Therlaing-therlain therlaings, " * 7, "en")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.prepared(spark)
    return spark.createDataFrame([(*r, "s", "clash", 1, 2, "w", 3, 4, 5) for r in rows], DOCS).repartition(6)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup ---------------------------------------------------------------------------------------------------------

def slow_groups(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = defaultdict(list)
    for doc, text, _ in rows:
        by[bare(text)].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for content, members in by.items():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), i == 0, hashlib.sha256(content.encode()).hexdigest()) for i, m in enumerate(members)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rules", [{}, {"sent_rows": 0}, {"digest": lambda c: F.length(c) % 3}, {"digest": lambda c: F.length(c) % 3, "sent_rows": 0}])
def test_equal_texts_are_grouped_by_content(docs, rows, rules):
    """Digests that collide and repeated digests too many to send give the same groups."""
    found = exact_dedup.groups(docs, **rules)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow_groups(rows)


def test_a_large_group_is_spread_over_salts(spark):
    """Copies of one text reach the merge as one row per part and the second step as one row per salt."""
    copies = spark.range(0, 20_000, numPartitions=40).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    found = exact_dedup.groups(copies)
    assert found.filter("kept").collect()[0].asDict() | {"text_sha256": ""} == {"doc_id": 0, "keep_id": 0, "group_size": 20_000, "kept": True, "text_sha256": ""}
    assert found.filter("kept").count() == 1 and found.count() == 20_000
    rows = exact_dedup._numbered(copies, "doc_id", "text", F.xxhash64)
    assert rows.select("salt").distinct().count() > 8


def test_no_texts_no_groups(nothing):
    assert exact_dedup.groups(nothing).count() == 0


# --- spelling variants ----------------------------------------------------------------------------------------------------

def slow_words(rows, letters=6, least=5):
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().translate(common.LOWER).decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def slow_edits(word):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    letters = spelling._LETTERS
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}) - {word}


def slow_variants(counts, ratio=5):
    near = {w: [v for v in slow_edits(w) if v in counts] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    end = lambda w: end(form[w]) if form[w] else w
    return sorted((w, form[w] or "", end(w), n, len(near[w]), counts[form[w]] if form[w] else 0) for w, n in counts.items())


def plain(found):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())


@pytest.mark.parametrize("search", [{}, {"leaf": 4, "leaf_sample": 1}, {"sample": 10, "leaf_sample": 2, "home": 3}])
def test_variants_match_all_edits(docs, rows, search):
    """Single boxes, many boxes, and boxes from a tiny sample cut into blocks give the same near words."""
    counts = slow_words(rows)
    found = spelling.variants(docs, **search)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain(found) == slow_variants(counts)
    assert any(r[4] > 2 for r in slow_variants(counts)) and any(r[1] for r in slow_variants(counts))


def test_near_words_of_a_dense_vocabulary(spark):
    """Anagrams, words of one repeated letter, accents, long words and chains of forms."""
    rng = random.Random(9)
    words = {"".join(rng.choices("abéÀ", k=rng.randint(6, 9))): rng.randint(5, 4000) for _ in range(1500)}
    words |= {"a" * n: 6 ** (n - 5) for n in range(6, 13)} | {"z" * 5000: 5, "z" * 4999 + "y": 30, "z" * 4999: 200}
    table = common.settle(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5), "dense-words")
    expected = {frozenset((w, v)) for w in words if len(w) < 50 for v in slow_edits(w) if v in words} | {
        frozenset(("z" * 5000, "z" * 4999 + "y")), frozenset(("z" * 5000, "z" * 4999)), frozenset(("z" * 4999, "z" * 4999 + "y"))}
    for search in ({"leaf": 16, "leaf_sample": 1}, {"home": 40}):
        found = spelling.near_pairs(table, **search).collect()
        assert Counter(frozenset((r.a, r.b)) for r in found) == Counter(expected)
        assert all(words[r.a] == r.an and words[r.b] == r.bn for r in found)


def test_roots_follow_all_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"w{i}": "w21" for i in range(21)} | {"x": "w21"}


def test_no_words_no_variants(spark, nothing):
    assert spelling.variants(nothing).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words", "en")], "doc_id long, text string, lang string")).count() == 0


# --- collocations ---------------------------------------------------------------------------------------------------------

def slow_collocations(rows, least=10, top=2000, longest=3):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(common.LOWER).decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("rules", [{}, {"trigger": 1}, {"trigger": 2, "bits": 64, "top": 3}, {"trigger": 10 ** 6, "longest": 4, "least": 4}, {"longest": 2}])
def test_collocations_match_direct_counts(docs, rows, rules):
    """However texts are parsed and however full the bit table is, counts and ranks are the same."""
    found = collocations.collocations(docs, **rules)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    slow = {k: v for k, v in rules.items() if k not in ("trigger", "bits")}
    assert sorted(map(tuple, found.collect())) == slow_collocations(rows, **slow)


def test_repeated_chunks_are_counted_once_with_their_weight(spark):
    copies = spark.createDataFrame([(i, "one two three four five six seven", "en") for i in range(50)], "doc_id long, text string, lang string")
    parsed = collocations.dictionary(copies, trigger=3).collect()
    assert all(r.times == 50 for r in parsed) and sum(r.own for r in parsed) == 7


def test_scores_are_exact_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", 1, "a", 3_000_000_000_001), ("en", 1, "b", 3_000_000_000_000), ("en", 2, "a b", 2_999_999_999_999)], "lang string, size int, phrase string, f long")
    row = collocations.candidates(found).collect()[0]
    assert row.score == 1_000_000 * row.a * row.a // (row.l * row.r) == 999_999


def test_ties_at_the_cut(spark):
    rows = spark.createDataFrame([("en", f"p{i:03d}", 10 + i % 2, 10, 10, 1_000_000) for i in range(300)] + [("de", "q", 10, 10, 10, 5)], "lang string, phrase string, a long, l long, r long, score long")
    first = collocations.first_of_each(rows, 100).collect()
    assert sorted((r.rank, r.phrase) for r in first if r.lang == "en") == [(k + 1, f"p{2 * k + 1:03d}") for k in range(100)]
    assert [(r.rank, r.phrase) for r in first if r.lang == "de"] == [(1, "q")]


def test_no_texts_no_collocations(nothing):
    assert collocations.collocations(nothing).count() == 0
