"""Golden vectors for text rules, control flow, regions and name matching."""

import random
import time

from pyspark.sql import functions as F

from launchlake.functions import scalars as S
from launchlake.functions import text as T
from launchlake.operators import listings as K
from launchlake.operators import resolve as R
from launchlake.operators import text_data as X
from launchlake.sources import code as C
from launchlake.streaming.stateful import match_name

NORMALIZED = [
    ("IADD3 R12, R13, c[0x0][0x20], RZ", "IADD3 REG, REG, CONST, ZERO"),
    ("@P0 BRA L_3", "@PRED BRA LABEL"),
    ("CALL.REL.NOINC `($cuda_crc32_tweaked$__cuda_sm20_bfe_u64_)", "CALL LABEL"),
    ("BRA `(.L_x_0)", "BRA LABEL"),
    ("MOV R2, 32@lo(CRCTable)", "MOV REG, IMM"),
    ("LDC R8, c[0x0][0x20] &wr=0 ?trans1", "LDC REG, CONST"),
    ("S2R R8, SR_TID.X &wr=0 ?trans1", "S2R REG, SREG"),
    ("FMUL R8, R9, 5.5511151231257827021e-17 &req={0, 1} ?trans1", "FMUL REG, REG, IMM"),
    ("BSSY B0, `(.L_x_70)", "BSSY BREG, LABEL"),
    ('BRX R18 -L_3090 (*"BRANCH_TARGETS .L_x_64634,.L_x_64635"*)', "BRX REG, LABEL"),
    ("LDG.E R8, [R2+0x10]", "LDG REG, MEM"),
    ("@!P1 IADD3 R1, -0x1f, -R2.H0, !PT ;", "@!PRED IADD3 REG, IMM, REG, PRED"),
    ("NOP", None), ("@P0 NOP", None), ("L_0:", None), ("  ", None),
]


def listing(spark, lines):
    df = spark.createDataFrame([(1, lines)], "kernel_id long, lines array<string>")
    return K.with_control(K.instructions_from_lines(df))


def test_normalize(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NORMALIZED)], "i int, a string")
    got = [r.n for r in df.select("i", T.normalize_instruction("a").alias("n")).orderBy("i").collect()]
    assert got == [b for _, b in NORMALIZED]


def test_opcode_reading_quirks(spark):
    lines = ["@PRED IADD3 REG", "POPC REG", "KERNEL_BOUNDARY", "IADD3 REG, REG, IMM, ZERO"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = df.select(T.opcode_normalized("line").alias("a"), T.opcode_normalized("line", compat=False).alias("b"), T.token_count("line").alias("n")).collect()
    assert [r.a for r in rows] == ["RED", "OPC", "", "IADD3"]
    assert [r.b for r in rows] == ["IADD3", "POPC", "", "IADD3"]
    assert rows[3].n == 8


def test_predicated_branch_falls_through(spark):
    ins = listing(spark, ["L_0:", "IADD3 R1, R1, 0x1, RZ", "@P0 BRA L_0", "EXIT"])
    assert sorted(r.type for r in K.control_flow_edges(ins).collect()) == ["branch", "fallthrough"]


def test_loops_need_a_backward_branch(spark):
    ins = listing(spark, ["IADD3 R0, R0, 0x1, RZ", "L_10:", "LOP3 R1, R1, R2, R3, 0xff, PT", "BRA L_10"])
    loop = K.natural_loops(ins).first()
    assert (loop.start, loop.end) == (1, 2)
    own = listing(spark, ["RET", "L_trap:", "BRA L_trap"])
    assert K.natural_loops(own).count() == 0


def region(spark, lines):
    return K.main_ranges(listing(spark, lines)).first()


def test_regions(spark):
    lop = "LOP3 R1, R1, R2, R3, 0xff, PT"
    r = region(spark, [lop] * 300 + ["RET", "L_trap:", "BRA L_trap"])
    assert (r.reason, r.start, r.end) == ("compute_region", 0, 299)
    r = region(spark, ["NOP"] * 24 + ["L_a:"] + [lop] * 80 + ["L_b:"] + ["IMAD R4, R5, R6, R7"] * 90 + ["L_c:"] + ["SHF.R R8, RZ, 0x10, R9"] * 90
               + ["L_tail:", "NOP", "EXIT"])
    assert r.reason == "compute_region" and r.end - r.start + 1 >= 128
    r = region(spark, ["IADD3 R1, R1, 0x1, RZ", lop])
    assert (r.reason, r.start, r.end) == ("full_kernel_small", 0, 1)
    r = region(spark, ["CALL.REL.NOINC 0x100"] * 140 + ["L_compute:"] + [lop] * 160 + ["L_tail:", "EXIT"])
    assert (r.reason, r.start, r.end) == ("compute_region", 140, 299)
    r = region(spark, [lop] * 1200)
    assert r.reason == "compute_region" and 512 <= r.end - r.start + 1 <= 768


def test_listing_dialects(spark):
    cu = ("Fatbin elf code:\n        Function : _Z6kernelv\n        /*0000*/                   IADD3 R1, R2, 0x1, RZ ;      /* 0x0 */\n"
          "        /*0010*/              @!P0 BRA 0x0000 ;             /* 0x0 */\n")
    nv = "\n        .type           crc,@function\ncrc:\n        /*0000*/                   MOV R1, R2 ;\n        /*0010*/                   EXIT ;\n"
    odd = "Function : $\t \n \t\n\t.headerflags\t@\"EF\"\n        /*0000*/                   MOV R1, R2 ;\n"
    df = spark.createDataFrame([(1, cu), (2, nv), (3, odd)], "code_id long, text string")
    rows = C.read_listings(df).orderBy("code_id", "idx").collect()
    assert [(r.code_id, r.text) for r in rows] == [
        (1, "IADD3 R1, R2, 0x1, RZ"), (1, "@!P0 BRA 0x0000"), (2, "MOV R1, R2"), (2, "EXIT"), (3, "MOV R1, R2")]
    assert rows[-1].function == "$\t \n \t"
    raw = C.read_listings(df).where("code_id = 1").select(F.col("code_id").alias("kernel_id"), "idx", "addr", "text")
    named = K.label_branch_targets(raw).orderBy("idx").collect()
    assert named[0].labels == ["L_0"] and named[1].text == "@!P0 BRA L_0"


def test_code_formats(spark):
    df = spark.createDataFrame([(bytearray.fromhex("50ed55ba01001000"),), (bytearray(b"\x7fELF\0"),), (bytearray(b".version 7\n"),), (bytearray(b"plain"),)], "c binary")
    assert [r.f for r in df.select(C.code_format("c").alias("f")).collect()] == ["fatbin", "cubin", "ptx", "unknown"]


def test_name_ladder(spark):
    funcs = spark.createDataFrame([(0, "_Z18cuda_ethash_searchv", 1, 0), (0, "_Z5otherv", 2, 1), (1, "a\n b", 1, 0)], "code_id long, function string, n_instr long, ord long")
    pairs = spark.createDataFrame([("cuda_ethash_search", 0), ("missing_name", 0), ("_Z5otherv", 0), ("a\r b", 1), ("z", 1)], "kernel_name string, code_id long")
    got = {r.kernel_name: (r.function, r.match) for r in R.resolve_names(pairs, funcs).collect()}
    assert got["cuda_ethash_search"] == ("_Z18cuda_ethash_searchv", "substring_name")
    assert got["missing_name"] == ("_Z5otherv", "largest_function_fallback")
    assert got["_Z5otherv"][1] == "exact" and got["a\r b"][1] == "canonical_name" and got["z"][1] == "largest_function_fallback"
    assert match_name("k_search", ["x", "_k_search_"]) == "_k_search_" and match_name("q", []) is None


def test_budgets_and_chunks(spark):
    lines = spark.createDataFrame([(1, i, "IADD3 REG, REG, IMM, ZERO") for i in range(10)], "kernel_id long, idx int, line string").withColumn("cost", T.token_count("line"))
    assert K.truncate_prefix(lines, 17).count() == 2 and K.truncate_prefix(lines, 7).count() == 0
    assert [r.idx for r in K.truncate_suffix(lines, 17).orderBy("idx").collect()] == [8, 9]
    df = spark.createDataFrame([(1, list(range(10))), (2, [])], "w long, ids array<int>")
    got = X.chunk_tokens(df, "ids", 4, 1).orderBy("w", "chunk_index").collect()
    assert [r.input_ids for r in got] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9], []]


def test_names(spark):
    df = spark.createDataFrame([("kernel/name:with space", "Crypto Night_O3"), ("", "--")], "k string, w string")
    a, b = df.select(S.safe_kernel("k").alias("k"), S.safe_workload("w").alias("w"), S.group_id("w").alias("g")).collect()
    assert (a.k, a.w, a.g) == ("kernel_name_with_space", "crypto_night_o3", "Crypto Night") and (b.k, b.w) == ("kernel", "unknown")


def test_operands_are_told_apart_by_bracket_depth(spark):
    cases = [("IADD3 R1, [R2, c[R3]], R4", "IADD3 REG, MEM, REG"), ("LDG R1, [R2, [R3, [R4]]], R5", "LDG REG, MEM, REG"), ("MOV R1], R2, [R3], R4", "MOV REG], REG, MEM, REG"),
             ("MOV R1, R2, c[0x0][0x20]", "MOV REG, REG, CONST"), ("LD R1, [R2, R3", "LD REG, [REG, REG")]
    got = spark.createDataFrame(cases, "line string, want string").select("want", T.normalize_instruction("line").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_mangled_names_of_one_library_are_not_all_paired(spark):
    names = [f"_ZN2at6native29vectorized_elementwise_kernelILi4E{i:04d}EEvT0_" for i in range(2000)]
    hay = spark.createDataFrame([(1, n) for n in names], "code_id long, text string")
    needles = spark.createDataFrame([(1, n[:-3]) for n in names] + [(1, "_ZN2at6nothing"), (1, "v")], "code_id long, needle string")
    met = R.containment_candidates(needles, hay)
    assert met.where("needle = 'v'").count() == 2000 and met.where("needle = '_ZN2at6nothing'").count() == 0
    longer = met.where("length(needle) > 1")
    assert longer.where("contains(text, needle)").count() == 2000
    assert longer.count() <= 10 * 2000


def test_loop_depth_is_the_number_of_containing_loops(spark):
    rnd = random.Random(4)
    loops = sorted({(rnd.choice("ab"), *sorted(rnd.sample(range(40), 2))) for _ in range(300)})
    loops += [("c", 1, 9), ("c", 1, 9), ("d", 0, 0)]  # equal loops contain each other
    got = K.loop_nesting(spark.createDataFrame(loops, "kernel_id string, start int, end int")).collect()
    want = [(k, a, b, sum(k == l and c <= a and b <= d for l, c, d in loops) - 1) for k, a, b in loops]
    assert sorted((r.kernel_id, r.start, r.end, r.depth) for r in got) == sorted(want)


def test_hundred_thousand_loops_in_one_kernel(spark):
    """Nested like brackets: loop i runs from i to 300000 - i, so i others contain it; time stays near linear."""
    n = 100_000
    loops = spark.range(n).select(F.lit("k").alias("kernel_id"), F.col("id").cast("int").alias("start"), (300_000 - F.col("id")).cast("int").alias("end"))
    began = time.time()
    off = K.loop_nesting(loops).where("depth <> start").count()
    assert off == 0 and time.time() - began < 60


def test_dictionary_gives_the_same_lines_as_the_rules(spark):
    texts = ["IADD3 R1, R2, 0x10, RZ;", "@!P1 LDG.E R4, [R2+0x10];", "NOP", "BRA 0x1a0", "", "L_10:", None, "IADD3 R1, R2, 0x10, RZ;"]
    ins = spark.createDataFrame([(k, i, t) for k in "ab" for i, t in enumerate(texts)], "kernel_id string, idx int, text string")
    direct = K.rewrite_branches(ins).select("kernel_id", "idx", T.normalize_instruction("text").alias("line")).where("line is not null")
    direct = direct.select("*", T.token_count("line").alias("cost"), T.opcode_normalized("line").alias("op"))
    got = K.normalized_lines(ins, rewrite=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, direct.collect()))


def test_a_listing_is_read_in_its_row(spark):
    """Later bodies replace earlier ones, empty functions stay in one dialect only, and a file is read once and not shuffled."""
    body = lambda *xs: "".join(f"        /*{i * 16:04X}*/   {x} ;  /* 0x0 ; */\n" for i, x in enumerate(xs))
    cu = "".join(f"  Function : {n}\n\t.headerflags\t@\"X\"\n{b}" for n, b in [("a", body("NOP")), ("b", body("EXIT")), ("a", body("MOV\t R1,  R2", "RET")), ("b", ""), ("none", "")])
    cu += "/*0abc*/ A B; /*0abd*/\n C ;/*0abe*/ ;\n"
    nv = "".join(f"  .type  {n},@function\n{b}" for n, b in [("x", body("NOP")), ("y", ""), ("x", "/*1*/ P ; /*2*/ Q ;\n/*3*/;\n/*4*/ no end\n/*5*/ Z;")])
    df = spark.createDataFrame([(1, cu), (2, nv), (3, "nothing"), (4, None)], "code_id long, text string")
    want = [(1, "a", 0, 0, "0000", "MOV R1, R2"), (1, "a", 0, 1, "0010", "RET"), (1, "b", 1, 0, "0000", "EXIT"), (1, "none", 4, 0, "0abc", "A B"), (1, "none", 4, 1, "0abd", "C"),
            (2, "x", 0, 0, "1", "P"), (2, "x", 0, 1, "5", "Z"), (2, "y", 1, None, None, None)]
    for whole in (False, True):
        rows = C.read_listings(df, whole=whole)
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
    twice = C.read_listings(df.union(df)).collect()
    assert sorted(map(tuple, twice), key=str) == sorted(want, key=str)
    plan = C.read_listings(df, whole=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("regexp_extract_all") == 3  # two dialects of bodies, and names
