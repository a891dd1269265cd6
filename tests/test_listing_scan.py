"""Listings are scanned once, in the order their generator gives, and nothing is sorted, shuffled by text or written on the way."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from launchlake.operators import control_scan as C
from launchlake.operators import listings as K

OPS = ["IADD3", "LOP3", "SHF", "ISETP", "LDG", "NOP", "NOP", "BRA", "BRA", "EXIT", "FADD"]


def random_listing(rnd, kernel, n):
    """(kernel_id, idx, addr, text); some branches go nowhere."""
    rows = []
    for i in range(n):
        op = rnd.choice(OPS if rnd.random() < 0.8 else ["NOP", "EXIT"])
        guard = rnd.choice(["", "", "@P0 "])
        rest = f" 0x{rnd.randrange(n + 2) * 16:04x}" if op == "BRA" else "" if op in ("NOP", "EXIT") else " R1, R2"
        rows.append((kernel, i, f"{i * 16:04x}", guard + op + rest))
    return rows


def expected(rows):
    """Loops with depth and the best region of one listing, pair by pair."""
    n, ops = len(rows), [t.split(" ")[1 if t[0] == "@" else 0] for *_, t in rows]
    goal = [int(t.split("0x")[1], 16) // 16 if o == "BRA" else None for o, (*_, t) in zip(ops, rows)]
    goal = [g if g is not None and g < n else None for g in goal]
    flags = [dict(zip(C.FLAG_NAMES, C.op_flags(o))) for o in ops]
    loops = [(g, i) for i, g in enumerate(goal) if g is not None and g < i]
    nested = sorted((a, b, sum(c <= a and b <= d for c, d in loops) - 1) for a, b in loops)
    leads = [i for i in range(n) if i == 0 or i in goal or flags[i - 1]["closes"]]
    blocks = []
    for a, b in zip(leads, [*leads[1:], n]):
        blocks += [(c, min(c + 512, b) - 1) for c in range(a, b, 512)] if b - a > 768 else [(a, b - 1)]
    tries = []
    for x, (a, _) in enumerate(blocks):
        for y in range(x, len(blocks)):
            part = flags[blocks[y][0]: blocks[y][1] + 1]
            if not any(f["useful"] for f in part) and all(f["noise"] for f in part):
                break
            good = max((i for i in range(blocks[y][1] + 1) if not flags[i]["noise"]), default=None)
            if good is None or blocks[y][0] - a > 767 or y > x and blocks[y][1] - a + 1 > min(768, n):
                continue
            size = good - a + 1
            count = {k: sum(f[k] for f in flags[a: good + 1]) for k in C.FLAG_NAMES}
            if size > 0 and count["useful"] >= 2 and count["useful"] / size >= 0.2:
                score = (size + 2.0 * count["integer"] + 2.0 * count["bitwise"] + 1.5 * count["shift"] + 1.5 * count["predicate"] + count["memory"]
                         - 1.5 * count["noise"] - 2.0 * count["control"] - 4.0 * count["trivial"])
                tries.append((size >= min(128, n), score, score / size, -abs(size - min(512, n)), size, -a, good, y - x + 1))
    return nested, max(tries, default=None), len(tries)


def sample():
    rnd = random.Random(9)
    listings = [random_listing(rnd, k, rnd.choice([1, 2, 5, 30, 200, 900])) for k in range(60)]
    return listings + [[(60, i, f"{i * 16:04x}", "LOP3 R1, R2") for i in range(1300)], [(61, i, f"{i * 16:04x}", "NOP") for i in range(9)]]


def test_loops_depths_and_regions_are_those_of_all_pairs(spark):
    listings = sample()
    raw = spark.createDataFrame([r for x in listings for r in x], "kernel_id long, idx int, addr string, text string").coalesce(1)
    table = K.listing_columns(raw)
    for ordered, rows in ((True, table), (False, table.repartition(7))):
        loops = K.nested_loops(rows, ordered).collect()
        regions = {r.kernel_id: r for r in K.compute_regions(rows, ordered).collect()}
        for x in listings:
            k = x[0][0]
            nested, best, tried = expected(x)
            assert sorted((r.start, r.end, r.depth) for r in loops if r.kernel_id == k) == nested
            assert (k in regions) == (best is not None)
            if best:
                r = regions[k]
                assert (r.meets_min, r.score, r.density, r.instruction_count, -r.start, r.end, r.num_blocks, r.candidates) == (*best[:3], *best[4:], tried)
    control = K.with_control(K.label_branch_targets(raw))
    assert sorted(map(tuple, K.main_ranges(control).collect())) == sorted(map(tuple, K.main_ranges(table, True).collect()))
    scored = K.select_main_loop(K.loop_score(K.loop_nesting(K.natural_loops(control))))
    assert sorted(map(tuple, K.main_loops(table, True).select(scored.columns).collect())) == sorted(map(tuple, scored.collect()))
    # the report of branches says what the rewriting operator does
    report = {r.kernel_id: r for r in K.branch_report(K.listing_columns(raw, texts=True), True).collect()}
    named = K.label_branch_targets(raw).orderBy("kernel_id", "idx").collect()
    for x in listings:
        mine = [r for r in named if r.kernel_id == x[0][0]]
        got = report[x[0][0]]
        assert got.branches == [r.text for r in mine if "L_" in r.text]
        assert (got.labels, got.label_idx_sum) == (sum(len(r.labels) > 0 for r in mine), sum(r.idx for r in mine if r.labels))


def test_listings_are_cut_at_their_ends_only(monkeypatch):
    """A task takes a chunk of rows at a time; a listing may be longer than a chunk and start anywhere in a batch."""
    sizes = [3, 70, 1, 25, 6]
    rows = [(k, i) for k, n in enumerate(sizes) for i in range(n)]
    table = pa.table({"kernel_id": [k for k, _ in rows], "idx": pa.array([i for _, i in rows], pa.int32()), "addr": [f"{i:x}" for _, i in rows],
                      "ref": pa.array([None] * len(rows), pa.string()), "op": ["NOP"] * len(rows), "target": pa.array([None] * len(rows), pa.string())})
    monkeypatch.setattr(C, "CHUNK", 16)

    class Frame:
        dtypes = [("kernel_id", "bigint")]

        def mapInArrow(self, work, schema):
            return [r for b in work(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]

    got = C.scan(Frame(), lambda x: {"of": np.arange(len(x.first)), "n": x.size}, "n long", ordered=True)
    assert [(r["kernel_id"], r["n"]) for r in got] == list(enumerate(sizes))


def test_scans_of_listings_sort_and_join_nothing(spark, tmp_path):
    from launchlake.plans import kernel_queries as Q
    spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for rows in (K.nested_loops(Q.listed(spark, str(tmp_path)), True), K.compute_regions(Q.listed(spark, str(tmp_path)), True), K.main_ranges(Q.listed(spark, str(tmp_path)), True)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" not in plan and "Window" not in plan and "Join" not in plan


def test_rare_texts_are_read_in_place(spark):
    """Beyond what a dictionary may hold the rules run at the instruction; its text is not the key of a shuffle."""
    texts = ["IADD3 R1, R2, 0x10, RZ;", "IADD3 R1, R2, 0x10, RZ;", "@!P1 LDG.E R4, [R2+0x10];", "NOP", "BRA 0x1a0", "", "L_10:", None, "MOV R1, 0x3"]
    ins = spark.createDataFrame([(k, i, f"{i * 16:x}", t) for k in "ab" for i, t in enumerate(texts)], "kernel_id string, idx int, addr string, text string")
    all_sent, some_sent = K.normalized_lines(ins, rewrite=True), K.normalized_lines(ins, rewrite=True, most=1)
    assert some_sent.count() == 10 and sorted(map(tuple, some_sent.collect())) == sorted(map(tuple, all_sent.collect()))
    order = ["kernel_id", "idx"]
    assert K.scanned_lines(ins, most=2).orderBy(*order).collect() == K.scanned_lines(ins).orderBy(*order).collect()
    plan = some_sent._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_branch_targets_search_each_text_once(spark):
    raw = spark.createDataFrame([(1, 0, "0", "BRA 0x10"), (1, 1, "10", "CALL L_7, ;L_a; ,L_b"), (1, 2, "20", "MOV R1, L_"), (1, 3, "30", "EXIT")], "kernel_id long, idx int, addr string, text string")
    rows = K.branch_targets(raw)
    assert [(r.idx, r.target) for r in rows.orderBy("idx").collect()] == [(0, "L_10"), (1, "L_b")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 2  # the address, and the label in what it is rewritten to


def test_opcode_with_odd_blanks_and_guards(spark):
    cases = [("@P0 ", "@P0"), ("  @!P1  LDG.E R1", "LDG"), ("\tmov\tR1", "MOV"), ("IADD3.X", "IADD3"), ("", ""), ("@P0", "@P0"), ("@P0\tBRA", "BRA"), (" .x", ""), (None, None)]
    from launchlake.functions import text as T
    got = spark.createDataFrame(cases, "text string, want string").select(T.opcode("text").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_blocks_and_edges_are_found_in_the_scan(spark, tmp_path):
    listings = sample()[:30] + [[(90, 0, "0000", "@P0 EXIT"), (90, 1, "0010", "CALL 0x0"), (90, 2, "0020", "@!P1 BRA 0x0000"), (90, 3, "0030", "NOP")]]
    raw = spark.createDataFrame([r for x in listings for r in x], "kernel_id long, idx int, addr string, text string").coalesce(1)
    table = K.listing_columns(raw, guards=True)
    want_edges, want_blocks = set(), []
    for x in listings:
        n, ops = len(x), [t.split(" ")[1 if t[0] == "@" else 0] for *_, t in x]
        goal = [int(t.split("0x")[1], 16) // 16 if o == "BRA" else None for o, (*_, t) in zip(ops, x)]
        goal = [g if g is not None and g < n else None for g in goal]
        leads = [i for i in range(n) if i == 0 or i in goal or ops[i - 1] in ("BRA", "EXIT", "CALL")]
        block = [sum(a <= i for a in leads) - 1 for i in range(n)]
        for b, (first, last) in enumerate(zip(leads, [*(a - 1 for a in leads[1:]), n - 1])):
            want_blocks.append((x[0][0], b, first, last, last - first + 1, [f"L_{i * 16:x}" for i in range(first, last + 1) if i in goal]))
            if goal[last] is not None:
                want_edges.add((x[0][0], b, block[goal[last]], "branch"))
            if last < n - 1 and ops[last] != "EXIT" and (ops[last] != "BRA" or x[last][3][0] == "@"):
                want_edges.add((x[0][0], b, b + 1, "fallthrough"))
    control = K.with_control(K.label_branch_targets(raw))
    for rows, ordered in ((table, True), (table.repartition(5), False), (control, False)):
        edges = [tuple(r) for r in K.control_flow_edges(rows, ordered).collect()]
        assert len(edges) == len(want_edges) and set(edges) == want_edges
        groups = {(k, t) for k, _, _, t in want_edges}
        want = {(k, t, sum(e[0] == k and e[3] == t for e in want_edges), len({e[2] for e in want_edges if e[0] == k and e[3] == t})) for k, t in groups}
        assert {tuple(r) for r in K.edge_report(rows, ordered).collect()} == want
    assert sorted(map(tuple, K.basic_blocks(table, True).collect())) == sorted(want_blocks)
    spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from launchlake.plans.catalog import QUERIES
    for name in ("control_flow_edges", "distinct_edges", "basic_blocks", "branch_target_join"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" not in plan and "Window" not in plan and "Aggregate" not in plan, name


def test_opcode_mix_reads_each_text_once(spark, tmp_path):
    ins = spark.createDataFrame([(1, 0, "@P0 BRA 0x10"), (1, 1, "BRA 0x0"), (1, 2, ""), (1, 3, None), (2, 0, ".x")], "kernel_id long, idx int, text string")
    assert [tuple(r) for r in K.opcode_mix(ins).collect()] == [(1, "BRA", 2)]
    from launchlake.plans.catalog import QUERIES
    spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["opcode_mix"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert filters and not any("upper" in line or "concat" in line for line in filters)
