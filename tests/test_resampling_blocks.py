"""Draws packed by the block of clusters they hit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.hashing import md5_60_bits
from panelwright.operators import resampling as op


@pytest.mark.parametrize("head", ["20240724", "7:abc", "x" * 45, "x" * 60])
def test_md5_of_many_texts(head):
    a, b = np.arange(1, 112), np.array([0, 3, 9, 10, 99, 101, 5000, 70000])
    want = [[int(hashlib.md5(f"{head}:{x}:{y}".encode()).hexdigest()[:15], 16) for y in b] for x in a]
    assert md5_60_bits(head, a, b, cells=64).tolist() == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_draws_is_broadcast(spark):
    df = spark.range(600).select(F.col("id").alias("c"), F.lit(1.0).alias("x"))
    for out in (op.multiplicities(df, ["c"], 50, 1), op.draw_sequence(df, "c", 50, 1), op.replicate_sums(df, ["c"], ["x"], 50, 1)):
        draws = plan(out).split("CoGroup")[0]  # what is above the blocks
        assert "CoGroup" in plan(out) and "Broadcast" not in draws


def test_draws_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "HELD", 90)
    n, reps = 600, 30
    df = spark.range(n).select(F.col("id").alias("c")).repartition(5)
    want = {(rep, p): int(hashlib.md5(f"4:{rep}:{p}".encode()).hexdigest()[:15], 16) % n for rep in range(1, reps + 1) for p in range(n)}
    got = op.draw_sequence(df, "c", reps, 4).collect()
    assert {(r["attempt"], r["draw_position"] - 1): r["c"] for r in got} == want and len(got) == n * reps
    copies = {}
    for rep, p in sorted(want):
        copies[rep, want[rep, p]] = copies.get((rep, want[rep, p]), 0) + 1
        want[rep, p] = copies[rep, want[rep, p]]
    assert {(r["attempt"], r["draw_position"] - 1): r["copy"] for r in got} == want
    assert {(r["rep"], r["c"]): r["multiplicity"] for r in op.multiplicities(df, ["c"], reps, 4).collect()} == copies
    rows = {r["c"]: r["counts"] for r in op.replicate_counts(df, ["c"], reps, 4).collect()}
    assert len(rows) == n and all(rows[c][rep - 1] == copies.get((rep, c), 0) for c in rows for rep in range(1, reps + 1))


def test_counts_of_resampled_panels_equal_the_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t) for s in range(40) for t in range(12) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "site int, t int")
    copies = op.resample_panel(df, op.draw_sequence(df, "site", 20, 3), "site", "t")
    want = copies.groupBy("attempt").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("section_start").cast("int")).alias("n_sections"), F.count_distinct("site", "copy").alias("n_series")
    )
    assert sorted(map(tuple, op.resampled_counts(df, "site", "t", 20, 3).collect())) == sorted(map(tuple, want.collect()))
