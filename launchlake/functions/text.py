"""Column expressions over instruction text.

Everything is built-in expressions: regular expressions and array functions
evaluated next to the data, without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of rendered text.
KERNEL_BOUNDARY = "KERNEL_BOUNDARY"
CONTENT_BUDGET = 8190
BODY_BUDGET = 8189

# Control-flow mnemonics.
BRANCH_OPS = ["BRA", "BRX", "JMP", "JMX"]
TERMINAL_OPS = ["RET", "EXIT"]
CALL_OPS = ["CALL"]

# Opcode classes of the static features.
BITWISE_OPS = [
    "AND", "BFE", "BFI", "BREV", "FLO", "IADD3", "IMAD", "ISCADD", "LOP", "LOP3", "POPC", "PRMT", "SHF", "SHL", "SHR",
    "VABSDIFF", "XOR",
]
INTEGER_OPS = [
    "I2F", "I2I", "IABS", "IADD", "IADD3", "ICMP", "IDP", "IMAD", "IMNMX", "IMUL", "ISCADD", "ISETP", "LEA", "LOP",
    "LOP3", "POPC", "SHF", "SHL", "SHR", "VADD",
]
FLOAT_OPS = [
    "DADD", "DFMA", "DMUL", "DSETP", "F2F", "F2I", "FADD", "FCHK", "FFMA", "FMNMX", "FMUL", "FSEL", "FSETP", "HADD2",
    "HFMA2", "HMUL2", "MUFU",
]
MEMORY_PREFIXES = ["LD", "ST", "ATOM", "ATOMG", "RED", "SULD", "SUST"]
TENSOR_PREFIXES = ["HMMA", "IMMA", "MMA", "BMMA", "DMMA"]
FEATURE_BRANCH_OPS = ["BRA", "BRX", "JMP", "JMX", "RET", "EXIT", "CALL"]

# Mnemonic prefixes of the loop score.
LOOP_PREFIXES = {
    "integer": ["IADD", "IMAD", "IMUL", "ISCADD", "LEA", "LOP"],
    "bitwise": ["LOP3", "AND", "OR", "XOR", "BFE", "BFI", "POPC", "FLO"],
    "shift": ["SHF", "SHL", "SHR"],
    "predicate": ["ISETP", "PSETP", "FSETP"],
    "memory": ["LD", "LDG", "LDS", "LDC", "ST", "STG", "STS", "ATOM", "RED"],
    "control": ["BRA", "JMP", "EXIT", "RET", "CALL"],
    "noise": ["NOP", "BRA", "JMP", "EXIT", "RET", "CALL"],
}
TRIVIAL_CONTROL_OPS = ["NOP", "EXIT", "RET", "BRA", "CALL"]
# Opcodes whose symbolic operand is a code label.
LABEL_OPS = [
    "BRA", "BRX", "BSSY", "CALL", "JMP", "JMX", "PBK", "PCNT", "PEXIT", "PRET", "SSY", "SYNC",
]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.trim(_col(value), F.lit(" \t\n\x0b\f\r"))


def has_prefix(op: Column, prefixes: list[str]) -> Column:
    return op.rlike("^(" + "|".join(prefixes) + ")")


def tokens(text: Column | str) -> Column:
    """Whitespace tokens, each comma its own token."""
    spaced = F.replace(_col(text), F.lit(","), F.lit(" , "))
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text)).cast("long")


def opcode(text: Column | str) -> Column:
    """Upper-case mnemonic of a raw instruction, guard and modifiers dropped."""
    raw = _col(text)
    # most lines have no guard and no white space but blanks, and are cut without a pattern
    odd = raw.startswith("@") | raw.startswith(" ")
    for white in "\t\n\x0b\f\r":
        odd |= F.contains(raw, F.lit(white))
    plain = F.substring_index(F.substring_index(raw, " ", 1), ".", 1)
    # a guard is one only if something follows it
    return F.upper(F.when(odd, F.regexp_extract(raw, r"^\s*(?:@!?\w+\s+(?=\S))?([^\s.]*)", 1)).otherwise(plain))


def opcode_normalized(line: Column | str, compat: bool = True) -> Column:
    """Mnemonic read from normalized text; empty for labels and boundaries.

    ``compat`` keeps the published counting rule, which strips the characters
    ``@!PT0-9`` from the left of the first token: a guarded line yields
    ``RED`` and ``POPC`` becomes ``OPC``. Ratios, the gate and with them the
    windows depend on it. Without it the guard is skipped instead.
    """
    text = strip(line)
    skip = (text == "") | text.endswith(":") | (text == KERNEL_BOUNDARY)
    if compat:
        token = F.regexp_extract(text, r"^([^\s.]*)", 1)
        op = F.upper(F.regexp_replace(token, "^[@!PT0-9]+", ""))
    else:
        op = opcode(text)
    return F.when(skip, F.lit("")).otherwise(op)


def branch_target(text: Column | str) -> Column:
    """Last ``L_...`` operand, null when there is none."""
    # the greedy lead leaves the last operand; most lines have none and are not looked through at all
    last = F.regexp_extract_all(_col(text), F.lit(r"(?s)^(?:.*[\s,])?;*(L_[A-Za-z0-9_]+);*(?:[\s,].*)?$"), F.lit(1))
    return F.when(F.contains(_col(text), F.lit("L_")), F.try_element_at(last, F.lit(1)))


def is_predicated(text: Column | str) -> Column:
    return strip(text).rlike(r"^@!?\w+\s+")


def is_bitwise_integer(op: Column) -> Column:
    return op.isin(sorted(set(BITWISE_OPS + INTEGER_OPS)))


def is_memory(op: Column) -> Column:
    return has_prefix(op, MEMORY_PREFIXES)


def is_compute(op: Column) -> Column:
    return op.isin(sorted(set(BITWISE_OPS + INTEGER_OPS + FLOAT_OPS))) | has_prefix(op, TENSOR_PREFIXES)


def opcode_class(op: Column) -> Column:
    """First matching class; an opcode in several lists takes the earliest."""
    return (
        F.when(op.isin(BITWISE_OPS), "bitwise").when(op.isin(INTEGER_OPS), "integer")
        .when(is_memory(op), "memory").when(op.isin(FEATURE_BRANCH_OPS), "branch")
        .when(op.isin(FLOAT_OPS), "float").when(has_prefix(op, TENSOR_PREFIXES), "tensor").otherwise("other")
    )


def is_useful(op: Column) -> Column:
    return has_prefix(op, sum((LOOP_PREFIXES[k] for k in ("integer", "bitwise", "shift", "predicate", "memory")), []))


def is_noise(op: Column) -> Column:
    return has_prefix(op, LOOP_PREFIXES["noise"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _symbolic(operand: Column) -> Column:
    bare = strip(F.regexp_replace(strip(F.regexp_replace(operand, r"^[+\-]+", "")), "^`", ""))
    bare = strip(F.regexp_replace(bare, r"^\((.*)\)$", "$1"))
    return let(bare, lambda b: (b != "") & (b.rlike("[$@]") | b.rlike(r"^[A-Za-z_.][A-Za-z0-9_.$@+\-]*$")))


# Ordered rewrite rules inside an operand that is not one class as a whole.
OPERAND_RULES = [
    (r"\.reuse\b", ""),
    (r"(?i)\bURZ\b", "ZERO"),
    (r"(?i)\bRZ\b", "ZERO"),
    (r"(?i)!?\bPT\b", "PRED"),
    (r"(?i)!?\bP\d+\b", "PRED"),
    (r"(?i)\bUP\d+\b", "PRED"),
    (r"(?i)[-+]?\bUR\d+(?:\.[A-Za-z0-9_]+)?\b", "UREG"),
    (r"(?i)[-+]?\bR\d+(?:\.[A-Za-z0-9_]+)?\b", "REG"),
    (r"(?i)\bSR_[A-Za-z0-9_.]+\b", "SREG"),
    (r"(?i)\bB\d+\b", "BREG"),
    (r"(?i)-?\d*@(lo|hi)\([^)]+\)", "IMM"),
    (r"-?0x[0-9a-fA-F]+", "IMM"),
    (r"(?i)(?<![A-Za-z_])[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:e[-+]?\d+)?\b", "IMM"),
    (r"(?<![A-Za-z_])-?\d+\b", "IMM"),
    (r"\s+", " "),
]


def _operand(text: Column, op: Column) -> Column:
    rest = text
    for pattern, replacement in OPERAND_RULES:
        rest = F.regexp_replace(rest, pattern, replacement)
    return (
        F.when(text == "", "")
        .when(text.contains("[") & text.contains("]") & ~F.lower(text).startswith("c["), "MEM")
        .when(text.rlike(r"(?i)^[-+]?R\d+(?:\.[A-Za-z0-9_]+)?$"), "REG")
        .when(text.rlike(r"^-?(?:0x[0-9a-fA-F]+|\d+)$"), "IMM")
        .when(text.rlike(r"(?i)^(?:RZ|URZ)$"), "ZERO")
        .when(text.rlike(r"(?i)^-?c\[[^\]]+\]\[[^\]]+\](?:\s+.*)?$"), "CONST")
        .when(text.rlike(r"(?i)^B\d+$"), "BREG")
        .when(text.rlike(r"(?i)^[-+]?UR\d+(?:\.[A-Za-z0-9_]+)?$"), "UREG")
        .when(text.rlike(r"(?i)^!?(?:P|UP)\d+$|^!?PT$"), "PRED")
        .when(op.isin(LABEL_OPS) & _symbolic(text), "LABEL")
        .when(text.rlike(r"^(?:L_[A-Za-z0-9_]+|\.?L[A-Za-z0-9_.$]+|TARGET\d+)$"), "LABEL")
        .otherwise(strip(rest))
    )


def normalize_instruction(line: Column | str) -> Column:
    """Model-ready form of one instruction; null for labels, blanks and NOP."""
    raw = _col(line)
    bare = F.regexp_replace(F.regexp_replace(raw, r"/\*.*?\*/", ""), r"\(\*\".*?\"\*\)", "")
    text = F.rtrim(strip(F.when(raw.contains("*"), bare).otherwise(raw)), F.lit(";"))
    return let(F.when(~text.endswith(":"), text), lambda t: let(_without_notes(t), _guarded))


def _without_notes(text: Column) -> Column:
    """Drop scheduler annotations, looking for them only where they can be."""
    bare = F.regexp_replace(text, r"(?i)\s+\?trans\d+\b", "")
    bare = F.regexp_replace(bare, r"\s+&[A-Za-z_][A-Za-z0-9_]*=(?:\{[^}]*\}|\S+)", "")
    return F.when(text.contains("?") | text.contains("&"), bare).otherwise(text)


def _guarded(text: Column) -> Column:
    guard = F.when(text.rlike(r"^@![A-Za-z0-9_]+\s+"), "@!PRED ").when(
        text.rlike(r"^@[A-Za-z0-9_]+\s+"), "@PRED ").otherwise("")
    body = F.when(text.startswith("@"), strip(F.regexp_replace(text, r"^@!?[A-Za-z0-9_]+\s+", ""))).otherwise(text)
    parts = F.struct(guard.alias("guard"), F.upper(F.regexp_extract(body, r"^([^ .]*)", 1)).alias("op"),
                     F.regexp_replace(body, r"^[^ ]* ?", "").alias("rest"), (body != "").alias("some"))
    return let(parts, lambda p: F.when(p["some"] & (p["op"] != "NOP"), _joined(p)))


# Brackets inside brackets, or without a partner; for these operands are told apart by depth.
ODD_BRACKETS = r"\[[^\]]*(?:\[|$)|^[^\[]*\]|\][^\[]*\]"


def _split_by_depth(text: Column) -> Column:
    """Cut at the commas outside all brackets; a closing bracket without a partner counts for nothing."""
    def step(state: Column, char: Column) -> Column:
        depth = state["depth"]
        deeper = F.when(char == "[", depth + 1).when(char == "]", F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        written = F.when((char == ",") & (depth == 0), F.lit("\n")).otherwise(char)
        return F.struct(deeper.alias("depth"), F.concat(state["out"], written).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    return F.split(F.aggregate(F.split(text, ""), start, step)["out"], "\n")


def _joined(p: Column) -> Column:
    flat = F.split(p["rest"], r",(?![^\[\]]*\])")
    split = F.when(~p["rest"].contains(","), F.split(p["rest"], r"\s+")).when(p["rest"].rlike(ODD_BRACKETS), _split_by_depth(p["rest"])).otherwise(flat)
    operands = F.transform(F.transform(split, strip), lambda x: _operand(x, p["op"]))
    joined = F.array_join(F.filter(operands, lambda x: x != ""), ", ")
    return let(joined, lambda j: F.concat(p["guard"], p["op"], F.when(j == "", "").otherwise(F.concat(F.lit(" "), j))))


def is_instruction_line(line: Column | str) -> Column:
    text = strip(line)
    return (text != "") & ~text.endswith(":")
