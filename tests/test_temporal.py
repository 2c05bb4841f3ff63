import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import temporal as op


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [("a", t, v) for t, v in [(0, 1.0), (1, 2.0), (3, 4.0), (4, 3.0), (5, 5.0), (9, 1.0)]] + [("b", 2, 7.0), ("b", 3, None), ("b", 4, 9.0)]
    return spark.createDataFrame(rows, "s string, t int, v double")


def test_fill_calendar_inserts_every_missing_period(gappy):
    out = op.fill_calendar(gappy, ["s"], "t", F.lit(-1), F.lit(10))
    got = {(r["s"], r["t"]): r["v"] for r in out.collect()}
    assert len(got) == 24 and out.count() == 24
    assert got[("a", 2)] is None and got[("a", 3)] == 4.0 and got[("b", -1)] is None and got[("b", 10)] is None


def test_bounded_fill_stops_after_two(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, None, None, 5.0, None])], "s int, t int, v double")
    got = [r["v"] for r in op.bounded_ffill(df, ["s"], "t", ["v"], 2).orderBy("t").collect()]
    assert got == [1.0, 1.0, 1.0, None, 5.0, 5.0]


def test_antecedent_needs_all_three(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "s int, t int, v double")
    got = [r["x"] for r in op.antecedent(df, ["s"], "t", "v", "x").orderBy("t").collect()]
    assert got == [None, None, None, 3.0, 6.0]


def test_history_excludes_the_target_and_requires_contiguity(gappy):
    out = op.history_windows(gappy, ["s"], "t", ["v"], "v", [1, 2]).collect()
    got = {(r["s"], r["t"]): ([x["v"] for x in r["history_2"]], [x["v"] for x in r["history_1"]]) for r in out}
    assert got == {("a", 5): ([4.0, 3.0], [3.0])}


def test_lagged_long_matches_history(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "s int, t int, v double")
    pushed = {(r["t"], r["lag"]): r["value"] for r in op.lagged_long(df, ["s"], "t", ["v"], 2).collect()}
    arrays = op.explode_history(op.history_windows(df, ["s"], "t", ["v"], "v", [2]), "history_2", 2, ["v"], ["s", "t"]).collect()
    assert arrays and all(pushed[(r["t"], r["lag"])] == r["value"] for r in arrays)


def test_sections_and_gaps(gappy):
    s = {(r["s"], r["t"]): r["section"] for r in op.section_starts(gappy, ["s"], "t").collect()}
    assert s[("a", 1)] == 1 and s[("a", 3)] == 2 and s[("a", 9)] == 3 and s[("b", 4)] == 1
    r = op.section_summary(gappy, ["s"], "t").first()
    assert (r["n_records"], r["n_entities"], r["n_sections"], r["gap_count"]) == (9, 2, 4, 2)
    assert (r["section_length_min"], r["section_length_median"], r["section_length_max"]) == (1, 2.5, 3)


def test_acf_ignores_pairs_across_gaps(gappy):
    got = {r["lag"]: r["n_pairs"] for r in op.sequence_acf(gappy.where("s = 'a'"), ["s"], "t", "v", 3).collect()}
    assert got == {1: 3, 2: 1, 3: 0}


def test_lag1_correlation(spark):
    v = np.random.default_rng(1).normal(size=30)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "s int, t int, v double")
    r = op.lag1_autocorrelation(df, ["s"], "t", "v").first()
    assert r["rho"] == pytest.approx(np.corrcoef(v[:-1], v[1:])[0, 1]) and r["n_pairs"] == 29


def test_days_split_over_months(spark):
    d = dt.date
    df = spark.createDataFrame(
        [(1, d(2020, 1, 25), 8.0), (2, d(2020, 1, 29), 4.0), (1, d(2020, 2, 2), 8.0), (1, d(2020, 12, 26), 8.0)], "s int, d date, v double"
    )
    got = {(r["s"], r["year"], r["month"]): r["x"] for r in op.allocate_days_to_months(df, ["s"], "d", "v", "x", cap="2021-01-01").collect()}
    # the first composite ends at the other site's start after four days; the February gap falls back to eight days
    assert got[(1, 2020, 1)] == pytest.approx(8.0)
    assert got[(2, 2020, 1)] == pytest.approx(4.0 * 3 / 4) and got[(2, 2020, 2)] == pytest.approx(1.0)
    assert got[(1, 2020, 2)] == pytest.approx(8.0)
    assert got[(1, 2020, 12)] == pytest.approx(8.0) and (1, 2021, 1) not in got


def test_leave_one_year_out_opens_a_section(spark):
    df = spark.createDataFrame([(1, 12 * y + m, y) for y in range(3) for m in range(12)], "s int, t int, year int")
    out = op.leave_one_year_out(df, ["s"], "t", [0, 1, 2]).groupBy("omitted_year").agg(F.sum(F.col("section_start").cast("int")).alias("k"))
    assert {r["omitted_year"]: r["k"] for r in out.collect()} == {0: 1, 1: 2, 2: 1}


def test_deciles_follow_the_position_rule(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(23)], "id int, v double")
    got = [r["decile"] for r in op.ordered_decile(df, "v", ["id"]).orderBy("v", "id").collect()]
    assert got == [i * 10 // 23 + 1 for i in range(23)]
