"""Control flow is resolved in one order per kernel: references, repeated labels, and the sorts it takes."""

import re

from pyspark.sql import functions as F

from launchlake.operators import listings as K


def test_last_definition_of_a_label_counts_and_only_it_is_live(spark):
    lines = ["L_a:", "IADD3 R1, R1, 0x1, RZ", "L_a:", "L_b:", "LOP3 R1, R1, R2, R3, 0xff, PT", "@P0 BRA L_a", "BRA L_b", "BRA L_none", "EXIT"]
    ins = K.with_control(K.instructions_from_lines(spark.createDataFrame([(1, lines), (2, lines)], "kernel_id long, lines array<string>")))
    rows = ins.where("kernel_id = 2").orderBy("idx").collect()
    assert [r.labelled for r in rows] == [False, True, False, False, False, False]
    assert [r.target_idx for r in rows] == [None, None, 1, 1, None, None]
    assert sorted((r.start, r.end, r.integer, r.bitwise) for r in K.natural_loops(ins).where("kernel_id = 1").collect()) == [(1, 2, 1, 1), (1, 3, 1, 1)]
    edges = sorted((r.src, r.dst, r.type) for r in K.control_flow_edges(ins).where("kernel_id = 1").collect())
    assert edges == [(0, 1, "fallthrough"), (1, 1, "branch"), (1, 2, "fallthrough"), (2, 1, "branch")]


def test_edges_take_four_sorts(spark):
    raw = spark.range(1).select(F.col("id").alias("kernel_id"), F.lit(0).alias("idx"), F.lit("0").alias("addr"), F.lit("EXIT").alias("text")).repartition(4, "kernel_id")
    edges = K.control_flow_edges(K.with_control(K.label_branch_targets(raw)))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) <= 4
