"""Instruction tables: labels, blocks, edges, loops, regions, features.

Tables here are long: one row per instruction, keyed by ``kernel_id`` and
``idx``. A kernel's listing comes from one input row, so windows over one
kernel are bounded by it; they all reuse the one spread by ``kernel_id`` that
happened while listings were still whole rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchlake.functions import text as T
from launchlake.operators.control_scan import EDGES, LOOP_COUNTS, REASONS, SMALL_KERNEL, Listings, containing, scan
from launchlake.session import materialize


def _kernel():
    return Window.partitionBy("kernel_id")


def _upto():
    return _kernel().orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)


def instructions_from_lines(kernels: DataFrame, lines: str = "lines") -> DataFrame:
    """(kernel_id, idx, text, labels) from arrays of lines; ``name:`` is a label."""
    rows = kernels.select("kernel_id", F.posexplode(lines).alias("line_no", "line"))
    rows = rows.select("kernel_id", "line_no", T.strip("line").alias("line")).where(F.col("line") != "")
    is_label = F.col("line").endswith(":")
    order = _kernel().orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # a label belongs to the instruction after it
    rows = rows.withColumn("is_label", is_label).withColumn(
        "idx", F.sum((~is_label).cast("int")).over(order) - F.when(is_label, 0).otherwise(1)
    )
    grouped = rows.groupBy("kernel_id", "idx").agg(
        F.max(F.when(~F.col("is_label"), F.col("line"))).alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("is_label"), F.struct("line_no", "line")))).alias("named"),
    )
    labels = F.transform("named", lambda x: F.regexp_replace(x["line"], ":$", ""))
    return grouped.where(F.col("text").isNotNull()).select("kernel_id", F.col("idx").cast("int").alias("idx"), "text", labels.alias("labels"))


# Fixed value: the branch operand of a listing.
BRANCH_ADDRESS = r"\b(?:BRA|JMP|JMX|BRX)\b[^;]*\b(0x[0-9a-fA-F]+)\b"


def _label(addr: Column) -> Column:
    digits = F.regexp_replace(F.lower(addr), "^0+", "")
    return F.concat(F.lit("L_"), F.when(digits == "", "0").otherwise(digits))


def rewrite_branches(raw: DataFrame) -> DataFrame:
    """(kernel_id, idx, text) with branch addresses replaced by label names, row by row.

    Enough where nobody asks which instructions carry the labels.
    """
    return _with_names(raw).select("kernel_id", "idx", F.col("named").alias("text"))


def _with_names(raw: DataFrame) -> DataFrame:
    """Add the branch address (``hit``, empty or null without one) and the text that names it, each worked out once."""
    text, hit = F.col("text"), F.col("hit")
    rows = raw.withColumn("hit", F.when(_may_branch(text), _branch_address(text)))
    return rows.withColumn("named", F.when(hit != "", F.replace(text, hit, _address_name(hit))).otherwise(text))


def branch_targets(raw: DataFrame) -> DataFrame:
    """(kernel_id, idx, target) of the instructions that name a label once their address is rewritten."""
    # a filter on an exploded value stays above it, so no text is made and searched again to be filtered
    target = F.explode(F.array(T.branch_target("text"))).alias("target")
    return rewrite_branches(raw).select("kernel_id", "idx", target).where(F.col("target").isNotNull())


def _branch_named(text: Column) -> Column:
    return F.when(_may_branch(text), T.let(_branch_address(text), lambda hit: F.when(hit != "", F.replace(text, hit, _address_name(hit))).otherwise(text))).otherwise(text)


def _may_branch(text: Column) -> Column:
    """A cheap test that every text with a branch address passes."""
    return F.contains(text, F.lit("BR")) | F.contains(text, F.lit("JM"))


def _branch_address(text: Column) -> Column:
    return F.regexp_extract(text, BRANCH_ADDRESS, 1)


def _address_name(hit: Column) -> Column:
    return _label(F.regexp_replace(hit, "^0x", ""))


def label_branch_targets(raw: DataFrame) -> DataFrame:
    """Name branched-to addresses and rewrite branch operands to the names.

    Takes (kernel_id, idx, addr, text). Instructions and branch references
    share one window per address, so there is no self-join.
    """
    text = F.col("text")
    rows = raw.withColumn("hit", F.when(_may_branch(text), F.nullif(_branch_address(text), F.lit(""))))
    own = F.struct(F.col("addr").alias("a"), F.lit(False).alias("ref"))
    refer = F.struct(F.lower(F.substring("hit", 3, 1 << 30)).alias("a"), F.lit(True).alias("ref"))
    rows = rows.withColumn("mark", F.explode(F.when(F.col("hit").isNull(), F.array(own)).otherwise(F.array(own, refer))))
    rows = rows.select("kernel_id", "idx", "addr", "text", "hit", F.col("mark.a").alias("at"), F.col("mark.ref").alias("ref"))
    rows = rows.withColumn("named", F.max("ref").over(Window.partitionBy("kernel_id", "at"))).where(~F.col("ref"))
    labels = F.when(F.col("named"), F.array(_label(F.col("addr")))).otherwise(F.array().cast("array<string>"))
    text = F.when(F.col("hit").isNotNull(), F.replace(text, F.col("hit"), _address_name(F.col("hit")))).otherwise(text)
    return rows.select("kernel_id", "idx", text.alias("text"), labels.alias("labels"))


def with_control(ins: DataFrame) -> DataFrame:
    """Add opcode, guard flag, kernel size and, per branch, the target index.

    A label reference finds its definition in one order of labels per kernel; of
    several definitions the last one counts. Running counts are taken in a second
    order, by index, and left out by the optimizer where nobody reads them.
    """
    rows = ins.select(
        "kernel_id", "idx", "text", "labels", T.opcode("text").alias("op"), T.is_predicated("text").alias("predicated"),
        T.branch_target("text").alias("target"))
    # one row per definition and reference, and one for an instruction without any
    define = F.transform("labels", lambda x: F.struct(x.alias("label"), F.lit(True).alias("def")))
    refer = F.struct(F.col("target").alias("label"), F.lit(False).alias("def"))
    roles = F.when(F.col("target").isNotNull(), F.concat(define, F.array(refer))).when(F.size("labels") > 0, define).otherwise(
        F.array(F.lit(None).cast("struct<label:string,def:boolean>")))
    rows = rows.select("kernel_id", "idx", "text", "labels", "op", "predicated", F.posexplode(roles).alias("role_no", "role"))
    rows = rows.select("kernel_id", "idx", "text", "labels", "op", "predicated", "role_no", F.col("role.label").alias("label"), F.col("role.def").alias("def"))
    # the last definition of a label comes first, then the others, then its references
    by_label = _kernel().orderBy("label", F.desc("def"), F.desc("idx"))
    opens = F.col("def") & ~F.lag("label").over(by_label).eqNullSafe(F.col("label"))
    rows = rows.withColumn("opens", F.coalesce(opens, F.lit(False)))
    place = F.last(F.when(F.col("opens"), F.struct("label", "idx")), ignorenulls=True).over(by_label.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", place)
    aim = F.when(~F.col("def") & (F.col("place.label") == F.col("label")), F.struct(F.col("idx").alias("at"), F.col("place.idx").alias("goal")))
    rows = rows.select("kernel_id", "idx", "text", "labels", "op", "predicated", "role_no", "opens", aim.alias("aim"))
    # back to one row per instruction: its first role comes last and sees what the others found
    back = _kernel().orderBy("idx", F.desc("role_no")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"live": F.last(F.when(F.col("opens"), F.col("idx")), ignorenulls=True).over(back), "aim": F.last("aim", ignorenulls=True).over(back)})
    rows = rows.where(F.col("role_no") == 0)
    rows = rows.select("kernel_id", "idx", "text", "labels", "op", "predicated", F.coalesce(F.col("live") == F.col("idx"), F.lit(False)).alias("labelled"),
                       F.when(F.col("aim.at") == F.col("idx"), F.col("aim.goal")).alias("target_idx"))
    flags = {
        **{f"c_{k}": T.has_prefix(F.col("op"), p).cast("int") for k, p in T.LOOP_PREFIXES.items()},
        "c_trivial": F.col("op").isin(T.TRIVIAL_CONTROL_OPS).cast("int"),
        "c_useful": T.is_useful(F.col("op")).cast("int"),
    }
    rows = rows.withColumns(flags)
    control = F.col("op").isin(T.BRANCH_OPS + T.TERMINAL_OPS + T.CALL_OPS)
    sums = [F.sum(c).over(_upto()).alias(c.replace("c_", "s_")) for c in flags]
    return rows.select(
        "*", *sums, F.lag(control, 1, False).over(_kernel().orderBy("idx")).alias("after_control"), F.count(F.lit(1)).over(_kernel()).alias("n"),
        F.max(F.when(F.col("c_noise") == 0, F.col("idx"))).over(_upto()).alias("last_good"))


def listing_columns(raw: DataFrame, texts: bool = False, guards: bool = False) -> DataFrame:
    """What the scan of listings reads of (kernel_id, idx, addr, text): mnemonic, address, branch address and branch label, row by row.

    With ``texts``, branches with a label keep their rewritten text; with ``guards``, which edges ask for, predicated instructions are marked.
    """
    rows = _with_names(raw).withColumn("target", T.branch_target("named"))
    kept = [F.when(F.col("target").isNotNull(), F.col("named")).alias("branch")] if texts else []
    kept += [T.is_predicated("named").alias("predicated")] if guards else []
    return rows.select("kernel_id", "idx", "addr", _reference(F.col("hit")).alias("ref"), T.opcode("named").alias("op"), "target", *kept)


def _reference(hit: Column) -> Column:
    return F.when(hit != "", F.lower(F.substring(hit, 3, 1 << 30)))


def branch_report(listing: DataFrame, ordered: bool = False) -> DataFrame:
    """Per kernel: labels after ``label_branch_targets``, the sum of their places, and the rewritten branches in order."""
    return scan(listing, Listings.branches, "labels long, label_idx_sum long, branches array<string>", ordered)


# A control table says where branches go; columns of a listing leave it to the scan.
CONTROL_COLUMNS = ["kernel_id", "idx", "op", "labelled", "target_idx"]


def _scanned(rows: DataFrame, found, schema: str, ordered: bool, *more: str) -> DataFrame:
    if "labelled" in rows.columns:
        rows = rows.select(*CONTROL_COLUMNS, *more)
    return scan(rows, found, schema, ordered)


def branch_goals(control: DataFrame, ordered: bool = False) -> DataFrame:
    """(kernel_id, idx, target_idx) of the branches whose label is defined, of a control table or ``listing_columns`` (as all operators below)."""
    return _scanned(control, Listings.targets, "idx int, target_idx int", ordered)


def basic_blocks(listing: DataFrame, ordered: bool = False) -> DataFrame:
    """Blocks of ``listing_columns`` with bounds, size and labels."""
    return scan(listing, Listings.blocks, "block_id int, start_line int, end_line int, instructions long, labels array<string>", ordered)


def _edge_type(kind: str = "kind") -> Column:
    return F.element_at(F.array(*map(F.lit, EDGES)), F.col(kind) + 1).alias("type")


def control_flow_edges(control: DataFrame, ordered: bool = False) -> DataFrame:
    """Typed edges (src, dst, type) between blocks, each once; a listing has its ``guards``."""
    rows = _scanned(control, Listings.edges, "src int, dst int, kind int", ordered, "predicated")
    return rows.select("kernel_id", "src", "dst", _edge_type())


def edge_report(control: DataFrame, ordered: bool = False) -> DataFrame:
    """Per kernel and type: the number of ``control_flow_edges`` and of different blocks they lead to, counted where they are found."""
    rows = _scanned(control, Listings.edge_counts, "kind int, edges long, targets long", ordered, "predicated")
    return rows.select("kernel_id", _edge_type(), "edges", "targets")


LOOP_SCHEMA = "start int, end int, instruction_count long, " + ", ".join(f"{k} long" for k in LOOP_COUNTS)


def natural_loops(control: DataFrame, ordered: bool = False) -> DataFrame:
    """Back edges as loops with body counts."""
    return _scanned(control, Listings.loops, LOOP_SCHEMA, ordered)


def nested_loops(control: DataFrame, ordered: bool = False) -> DataFrame:
    """``natural_loops`` with their ``depth``, in the same scan."""
    def found(listings: Listings):
        loops = listings.loops()
        return loops | {"depth": containing(loops["of"], loops["start"], loops["end"])}

    return _scanned(control, found, LOOP_SCHEMA + ", depth long", ordered)


def main_loops(control: DataFrame, ordered: bool = False) -> DataFrame:
    """``select_main_loop`` of scored and nested loops, in one scan."""
    return _scanned(control, Listings.main_loops, "num_loops long, start int, end int, instruction_count long, score double, depth long", ordered)


def loop_nesting(loops: DataFrame) -> DataFrame:
    """Add ``depth``: other loops that contain a loop (ends included).

    Dominance counting: with loops ranked by start, and the longer first among equal starts, a loop is contained by
    exactly those before it that end no earlier. Every two ranks part at one power of two, into the left and the right half
    of a block; there a running count of the left half's loops, from the last end down, answers for the right half. A loop
    so takes part once per power of two, and no pair of loops is ever a row or in one array.
    """
    kernel = Window.partitionBy("kernel_id")
    ranked = kernel.orderBy("start", F.desc("end"))
    rows = loops.withColumns({"_nth": F.row_number().over(ranked), "_rank": F.dense_rank().over(ranked) - 1,
                              "_same": F.count(F.lit(1)).over(Window.partitionBy("kernel_id", "start", "end")) - 1, "_n": F.count(F.lit(1)).over(kernel)})
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("_n") + 1)).cast("int"))
    rows = rows.withColumn("_level", F.explode(levels))
    block = F.expr("shiftright(_rank, _level + 1)")
    left = F.expr("shiftright(_rank, _level) % 2 = 0")
    rows = rows.withColumns({"_block": block, "_left": left})
    down = Window.partitionBy("kernel_id", "_level", "_block").orderBy(F.desc("end"), F.desc("_left")).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_before", F.when(~F.col("_left"), F.sum(F.col("_left").cast("int")).over(down)).otherwise(0))
    own = [c for c in loops.columns if c != "kernel_id"]
    return counted.groupBy("kernel_id", *own, "_nth").agg((F.sum("_before") + F.max("_same")).alias("depth")).select("kernel_id", *own, "depth")


def loop_score(nested: DataFrame) -> DataFrame:
    c = F.col
    score = (c("instruction_count") + 2.0 * c("integer") + 2.0 * c("bitwise") + 1.5 * c("shift") + 1.5 * c("predicate")
             + c("memory") + 2.0 + c("depth"))
    return nested.withColumn("score", score.cast("double"))


def select_main_loop(scored: DataFrame) -> DataFrame:
    """Best loop per kernel; on ties the longer one, then the earlier one."""
    best = F.max(F.struct("score", "instruction_count", (-F.col("end")).alias("minus_end"), "start", "end", "depth"))
    return scored.groupBy("kernel_id").agg(best.alias("b"), F.count(F.lit(1)).alias("num_loops")).select(
        "kernel_id", "num_loops", "b.start", "b.end", "b.instruction_count", "b.score", "b.depth")


def compute_regions(control: DataFrame, ordered: bool = False) -> DataFrame:
    """Best run of blocks per kernel by weighted score, at most 768 instructions."""
    return _scanned(control, Listings.regions, "n long, start int, end int, score double, density double, instruction_count int, num_blocks int, meets_min boolean, "
                    "candidates long", ordered)


def main_ranges(control: DataFrame, ordered: bool = False) -> DataFrame:
    """(kernel_id, n, start, end, reason): main loop, small kernel, region, or all."""
    rows = _scanned(control, Listings.ranges, "n long, start int, end int, kind int", ordered)
    return rows.select("kernel_id", "n", "start", "end", F.element_at(F.array(*map(F.lit, REASONS)), F.col("kind") + 1).alias("reason"))


def opcode_mix(ins: DataFrame) -> DataFrame:
    # counted, not filtered: a filter is pushed below the text and builds it anew for every use of it
    rows = ins.select("kernel_id", T.opcode("text").alias("op"))
    return rows.groupBy("kernel_id", "op").agg(F.count_if(F.col("op") != "").alias("n")).where("n > 0")


# A dictionary is sent to every task with so many texts at most, the most frequent ones.
SENT_TEXTS = 1_000_000


def _line_rules(rewrite: bool) -> Callable[[Column], Column]:
    def rules(text: Column) -> Column:
        return T.let(T.normalize_instruction(_branch_named(text) if rewrite else text), lambda line: F.struct(
            line.alias("line"), T.token_count(line).alias("cost"), T.opcode_normalized(line).alias("op")))

    return rules


def _scan_rules(text: Column) -> Column:
    """All that scans read of a text: what ``listing_columns`` has, token cost (null where the line is dropped), class bits of the mnemonic."""
    def bits(op: Column) -> Column:
        tests = [op != "", T.is_bitwise_integer(op), T.is_memory(op), op.isin(T.FEATURE_BRANCH_OPS)]
        return sum((F.coalesce(b, F.lit(False)).cast("int") * (1 << i) for i, b in enumerate(tests)), F.lit(0))

    parts = F.struct(F.when(_may_branch(text), _branch_address(text)).alias("hit"), _branch_named(text).alias("named"), _line_rules(True)(text).alias("kept"))
    return T.let(parts, lambda p: F.struct(
        _reference(p["hit"]).alias("ref"), T.opcode(p["named"]).alias("op"), T.branch_target(p["named"]).alias("target"),
        F.when(p["kept"]["line"].isNotNull(), p["kept"]["cost"]).alias("cost"), bits(p["kept"]["op"]).alias("bits")))


def looked_up(ins: DataFrame, rules: Callable[[Column], Column], most: int = SENT_TEXTS) -> DataFrame:
    """Replace ``text`` by the fields of ``rules``; rows stay in their places and order.

    Listings repeat the same texts massively, so the rules run once per text and not once per instruction. The ``most``
    frequent texts are looked up in a dictionary that is written once and broadcast; at the others the rules run in place, so no
    instruction is shuffled by its text, of which one may be a large part of all.
    """
    counted = materialize(ins.groupBy("text").agg(F.count(F.lit(1)).alias("n")), "instruction-texts")
    every = counted.count() <= most
    texts = counted if every else counted.orderBy(F.desc("n"), "text").limit(most)
    # exploding a one-element array keeps the rules from running twice
    words = texts.repartition("text").select(F.col("text").alias("_text"), F.explode(F.array(rules(F.col("text")))).alias("_found"))
    words = materialize(words, "instruction-dictionary")
    rest = [c for c in ins.columns if c != "text"]
    rows = ins.join(F.broadcast(words), F.col("text").eqNullSafe(F.col("_text")), "left")
    found = F.col("_found") if every else F.when(F.col("_found").isNull(), rules(F.col("text"))).otherwise(F.col("_found"))
    if not every:
        return rows.select(*rest, F.explode(F.array(found)).alias("_found")).select(*rest, "_found.*")
    return rows.select(*rest, "_found.*")


def normalized_lines(ins: DataFrame, rewrite: bool = False, most: int = SENT_TEXTS) -> DataFrame:
    """Instructions that survive normalization, with text, token cost and mnemonic."""
    lines = looked_up(ins.select("kernel_id", "idx", "text"), _line_rules(rewrite), most)
    return lines.where(F.col("line").isNotNull())


def _mnemonic(lines: DataFrame, compat: bool = True) -> Column:
    return F.col("op") if compat and "op" in lines.columns else T.opcode_normalized("line", compat)


def truncate_prefix(lines: DataFrame, budget: int, key: str = "kernel_id", order: str = "idx") -> DataFrame:
    """Leading whole lines whose summed cost stays within the budget."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("cost_upto", F.sum("cost").over(upto)).where(F.col("cost_upto") <= budget)


def truncate_suffix(lines: DataFrame, budget: int, key: str = "kernel_id", order: str = "idx") -> DataFrame:
    """Trailing whole lines within the budget ("front clip")."""
    upto = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("cost_from", F.sum("cost").over(upto)).where(F.col("cost_from") <= budget)


def main_loop_lines(lines: DataFrame, ranges: DataFrame, budget: int = T.BODY_BUDGET) -> DataFrame:
    body = lines.join(ranges.select("kernel_id", "start", "end"), "kernel_id").where(F.col("idx").between(F.col("start"), F.col("end")))
    return truncate_prefix(body.drop("start", "end"), budget)


def scanned_lines(raw: DataFrame, most: int = SENT_TEXTS) -> DataFrame:
    """``listing_columns`` with token cost and class bits of what normalization leaves of each rewritten line."""
    return looked_up(raw, _scan_rules, most)


def static_features(lines: DataFrame, budget: int = T.BODY_BUDGET, ordered: bool = False) -> DataFrame:
    """Ten instruction features per kernel, whole kernel against main loop, of ``scanned_lines``."""
    names = ["n", "ln", "ops", "bit", "mem", "bra", "lbit", "lmem"]
    agg = scan(lines, partial(Listings.line_counts, budget=budget), ", ".join(f"{n} long" for n in names), ordered)
    c, empty = F.col, F.col("ln") == 0
    total = F.greatest(F.lit(1), c("ops"))
    lbit, lmem = F.when(empty, c("bit")).otherwise(c("lbit")), F.when(empty, c("mem")).otherwise(c("lmem"))
    return agg.select(
        "kernel_id", c("n").alias("instruction_count"), F.when(empty, c("n")).otherwise(c("ln")).alias("main_loop_instruction_count"),
        c("bit").alias("bitwise_integer_instruction_count"), c("mem").alias("memory_instruction_count"),
        c("bra").alias("branch_instruction_count"), (c("bit") / total).alias("bitwise_integer_ratio"),
        (c("mem") / total).alias("memory_instruction_ratio"), (c("bra") / total).alias("branch_density"),
        (c("bit") / F.greatest(F.lit(1), c("bit") + c("mem"))).alias("compute_intensity_score"),
        (lbit / F.greatest(F.lit(1), lbit + lmem)).alias("main_loop_compute_intensity_score"))


# Thresholds of the static signal, each (feature, default, at least).
SIGNAL_RULES = [
    ("instruction_count", 128, True),
    ("main_loop_instruction_count", 32, True),
    ("compute_intensity_score", 0.65, True),
    ("bitwise_integer_ratio", 0.35, True),
    ("memory_instruction_ratio", 0.35, False),
    ("branch_density", 0.02, True),
]


def static_signal(features: DataFrame, need: int = 4) -> DataFrame:
    hits = [F.when(F.col(n) >= v if up else F.col(n) <= v, F.lit(n)) for n, v, up in SIGNAL_RULES]
    reasons = F.array_compact(F.array(*hits))
    return features.select("kernel_id", (F.size(reasons) >= need).alias("signal"), reasons.alias("reasons"))


def bitwise_integer_ratio(lines: DataFrame, key: str = "kernel_id", compat: bool = True) -> DataFrame:
    op = _mnemonic(lines, compat)
    rows = lines.select(key, op.alias("op")).where(F.col("op") != "")
    return rows.groupBy(key).agg(F.avg(T.is_bitwise_integer(F.col("op")).cast("int")).alias("ratio"))


def compute_instruction_ratio(ins: DataFrame, key: str = "kernel_id") -> DataFrame:
    """Compute and memory shares over raw instruction text."""
    # counted, not filtered: a pushed-down filter would repeat the text rules
    rows = ins.select(key, T.opcode_normalized("text").alias("op"))
    out = rows.groupBy(key).agg(
        F.count_if(F.col("op") != "").alias("instruction_count"),
        F.count_if(T.is_compute(F.col("op"))).alias("compute_instruction_count"),
        F.count_if(T.is_memory(F.col("op"))).alias("memory_instruction_count")).where(F.col("instruction_count") > 0)
    return out.withColumn("compute_instruction_ratio", F.col("compute_instruction_count") / F.col("instruction_count"))


def render_fragments(lines: DataFrame, ranges: DataFrame, budget: int = T.CONTENT_BUDGET, short: int = SMALL_KERNEL) -> DataFrame:
    """Rendered lines of each kernel with mode and token cost, boundary last.

    Short kernels that fit are rendered whole, others by their main loop cut
    to the budget. One pass marks both choices on the line table.
    """
    body = budget - 1
    upto = _kernel().orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    loop_upto = Window.partitionBy("kernel_id", "inside").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.join(ranges.select("kernel_id", "start", "end"), "kernel_id", "left").withColumn(
        "inside", F.coalesce(F.col("idx").between(F.col("start"), F.col("end")), F.lit(False)))
    rows = rows.withColumns({
        "any_inside": F.max("inside").over(_kernel()), "n_lines": F.count(F.lit(1)).over(_kernel()), "total": F.sum("cost").over(_kernel()),
        "loop_upto": F.sum("cost").over(loop_upto), "all_upto": F.sum("cost").over(upto)})
    whole = (F.col("n_lines") <= short) & (F.col("total") <= body)
    limit = min(body, T.BODY_BUDGET)
    loop = F.when(F.col("any_inside"), F.col("inside") & (F.col("loop_upto") <= limit)).otherwise(F.col("all_upto") <= body)
    rows = rows.withColumn("mode", F.when(whole, "full_kernel").otherwise("main_loop")).where(whole | loop)
    return rows.select("kernel_id", "idx", "line", "cost", "mode")


def fragment_summary(lines: DataFrame, budget: int = T.CONTENT_BUDGET, short: int = SMALL_KERNEL, ordered: bool = False) -> DataFrame:
    """Per kernel: mode, rendered lines, token cost with boundary, op ratio of what ``render_fragments`` gives, from ``scanned_lines``."""
    found = partial(Listings.fragments, body=budget - 1, limit=min(budget - 1, T.BODY_BUDGET), short=short)
    rows = scan(lines, found, "whole boolean, lines long, cost long, ops long, bit long", ordered)
    return rows.select(
        "kernel_id", F.when(F.col("whole"), "full_kernel").otherwise("main_loop").alias("render_mode"), F.col("lines").alias("rendered_instruction_count"),
        (F.col("cost") + 1).alias("token_cost"), F.when(F.col("ops") > 0, F.col("bit") / F.col("ops")).otherwise(0.0).alias("ratio"))
