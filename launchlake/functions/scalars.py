"""Column expressions for names, units, readiness and status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Parse a number; anything unparseable is null."""
    return _col(value).cast("string").try_cast("double")


def counter_number(value: Column | str) -> Column:
    """Parse a monitor cell: placeholders are null, unit marks are dropped."""
    text = F.trim(_col(value).cast("string"))
    # The placeholder cells of the monitor output.
    blank = text.isin("", "-", "N/A", "[N/A]", "Not Supported", "[Not Supported]")
    bare = F.trim(F.regexp_replace(text, "%|MiB|W|C", ""))
    return F.when(~blank, bare.try_cast("double"))


def mib_to_bytes(value: Column | str) -> Column:
    return (counter_number(value) * 1024 * 1024).cast("long")


def dash_to_null(value: Column | str) -> Column:
    text = _col(value)
    return F.when(~text.isin("", "-"), text)


def safe_workload(value: Column | str) -> Column:
    """Lower-case name of word characters; empty becomes ``unknown``."""
    text = F.regexp_replace(_col(value), "[^A-Za-z0-9_]+", "_")
    text = F.lower(F.regexp_replace(text, "^_+|_+$", ""))
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def safe_kernel(value: Column | str) -> Column:
    """File-safe kernel name; long names keep 100 characters and a digest."""
    raw = _col(value)
    text = F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "_"), "^[.-]+|[.-]+$", "")
    text = F.when(text == "", F.lit("kernel")).otherwise(text)
    short = F.concat(F.substring(text, 1, 100), F.lit("_"), F.substring(F.sha1(raw.cast("binary")), 1, 12))
    return F.when(F.length(text) > 120, short).otherwise(text)


def group_id(workload: Column | str) -> Column:
    """Workload name without one trailing optimisation suffix."""
    return F.regexp_replace(_col(workload), "(?i)_o[0-9]+$", "")


def split_variant(workload: Column | str) -> tuple[Column, Column]:
    """(program, variant) from a workload name ending in ``_o2`` or ``_o3``."""
    name = _col(workload)
    suffixed = name.rlike("(?i)_o[23]$")
    program = F.when(suffixed, F.regexp_replace(name, "(?i)_o[23]$", "")).otherwise(name)
    variant = F.when(suffixed, F.lower(F.substring(name, -2, 2))).otherwise(F.lit("default"))
    return program, variant


# Workload family to primary label.
PRIMARY_LABELS = {
    "ai": "benign_compute_like",
    "hpc": "benign_compute_like",
    "graph": "benign_compute_like",
    "image_signal": "benign_compute_like",
    "cuda_samples": "benign_compute_like",
    "crypto_benign": "benign_crypto_hash_like",
    "compression": "benign_crypto_hash_like",
    "memory": "benign_memory_like",
    "cryptonight_randomx_scratchpad": "mining_like",
    "cuckoo_graph_cycle": "mining_like",
    "equihash_solver": "mining_like",
    "ethash_dag_keccak": "mining_like",
    "heavyhash_matrix_like": "mining_like",
    "memory_hard_table_hash": "mining_like",
    "modern_alt_hash_pow": "mining_like",
    "multi_hash_chain": "mining_like",
    "progpow_kawpow_random_math": "mining_like",
    "pure_hash_nonce_search": "mining_like",
}


def primary_label(family: Column | str) -> Column:
    pairs = [F.lit(x) for item in PRIMARY_LABELS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _col(family))


def binary_label(label: Column | str) -> Column:
    return F.when(_col(label) == "mining_like", F.lit("mining")).otherwise(F.lit("benign"))


def shape_key(dims: Column | str) -> Column:
    return F.array_join(_col(dims).cast("array<string>"), "x")


def percent_of(value: Column | str, total: Column | str) -> Column:
    v, t = _col(value).cast("double"), _col(total).cast("double")
    return F.when(t != 0, v / t * 100)


def bytes_to_gb(value: Column | str) -> Column:
    return _col(value) / F.lit(1e9)


def ns_to_ms(value: Column | str) -> Column:
    return _col(value) / F.lit(1e6)


def ns_to_us(value: Column | str) -> Column:
    return _col(value) / F.lit(1e3)


def total_launches(log: Column | str) -> Column:
    """The ``total_launches=<n>`` figure of a run log, 0 when it has none."""
    hit = F.regexp_extract(_col(log), r"(?m)^total_launches=(\d+)", 1)
    return F.coalesce(hit.try_cast("long"), F.lit(0).cast("long"))


def process_verdict(status: Column, util: Column, memory: Column, ram: Column, util_std: Column) -> Column:
    """Rule-based verdict over one process window."""
    util, memory, ram, util_std = (number(c) for c in (util, memory, ram, util_std))
    missing = util.isNull() | memory.isNull() | ram.isNull() | util_std.isNull()
    benign = (util <= 80) | (memory <= 90) | (ram < 3) | (ram > 4.5) | (util_std >= 3.5)
    return (
        F.when(status == "insufficient_process_util", F.lit("insufficient_process_util"))
        .when(missing, F.lit("insufficient_metrics"))
        .when(benign, F.lit("benign"))
        .otherwise(F.lit("suspicious_mining"))
    )
