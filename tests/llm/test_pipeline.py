"""The pipeline stage by stage against brute force, on a folder of small tables."""

import math
import random

import numpy as np
import pytest
from test_operators import prose, slow_components, slow_fingerprint, slow_ids, slow_spans

import corpus_pipeline
from launchlake.llm import packing
from launchlake.session import scratch_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _key string, row_key string, found string, language_found string, fp string, id string"
CLASHES = ("k", "f", "l", "p", "i")


def documents():
    rng = random.Random(21)
    texts = {i: prose(rng, rng.choice(["en", "de", "es"]), rng.randint(20, 90)) for i in range(60)}
    item = prose(random.Random(5), "en", 25)
    texts[60] = texts[3]  # an exact copy
    texts[61] = texts[4] + " er"  # maybe a near copy, whatever brute force says
    texts[62] = prose(rng, "de", 30) + " " + item + " " + prose(rng, "de", 10)
    texts[63] = prose(rng, "en", 40) + " mail ann@example.com or +1 555 234 5678 now"
    texts[64], texts[65], texts[66], texts[67] = None, "", "123 !!!", prose(rng, "en", 4000)
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else "s", len(t or ""), "x", f"y{i}", *CLASHES) for i, t in texts.items()]
    rows += [rows[5], (6, prose(rng, "es", 40), "es", "s", 9, None, "y6", *CLASHES), (None, prose(rng, "en", 35), "en", None, None, None, None, *CLASHES)]
    return rows, [(0, item), (1, None), (2, "short one")]


@pytest.fixture(scope="module")
def folder(spark):
    rows, items = documents()
    path = scratch_dir(spark, "pipeline-test")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_does_its_part(spark, folder):
    rows, items = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch_dir(spark, name)
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            assert all(tuple(r)[7:] == CLASHES and (r.doc_id is None or r._key == f"y{r.doc_id}") for r in seen[name])
    key = lambda r: (r[0], r[1])
    ordered = lambda pairs: sorted(pairs, key=str)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert ordered(map(key, seen["language_id"])) == ordered(map(key, lettered))

    distinct = {key(r) for r in lettered}
    prints = {(k[0] if k[0] is not None else -1, k[1]): slow_fingerprint(k[1]) for k in distinct}
    numbered = {i: k for i, k in enumerate(sorted(prints, key=lambda k: (k[0], 0)))}
    groups = slow_components({i: prints[k] for i, k in numbered.items()})
    kept = [(r.doc_id, r.text) for r in seen["near_duplicates"]]
    number = {k: i for i, k in numbered.items()}
    found = [groups[number[-1 if d is None else d, t]] for d, t in kept]
    assert sorted(found) == sorted(set(groups.values()))  # one of each group
    assert (3, rows[3][1]) in kept and 60 not in {d for d, _ in kept}

    assert {d for d, _ in kept} - {r.doc_id for r in seen["decontamination"]} == {62}
    clean = {(r.doc_id, r.text): r for r in seen["pii"]}
    assert not any(slow_spans(t) for _, t in clean) and any("[EMAIL]" in t and "[PHONE]" in t for d, t in clean if d == 63)
    assert all(r.n_chars == len(r.text) for r in clean.values()) and len(clean) == len(seen["decontamination"])
    lengths = [len(slow_ids(t)) for _, t in clean]
    packed = seen["packing"]
    assert sum(r.length for r in packed) == sum(lengths)
    assert len({r.sequence_id for r in packed}) <= math.ceil(sum(lengths) / packing.CAPACITY) + 1
    assert np.all([r.length <= packing.CAPACITY for r in packed])


def test_run_is_the_stages_and_takes_an_empty_table(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    path = scratch_dir(spark, "pipeline-empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
