import math

import pytest
from pyspark.sql import functions as F

from panelwright.operators import attribution as op
from panelwright.operators.temporal import explode_history, history_windows
from panelwright.plans import QUERIES


@pytest.fixture(scope="module")
def both(spark):
    """Long and nested attributions of one panel with a missing background for one lag."""
    rows = [(s, p, float((s * 7 + p * 3) % 5), float("nan") if (s, p) == (2, 4) else 0.1 * ((s + p) % 3), float(p)) for s in range(4) for p in range(9)]
    panel = spark.createDataFrame(rows, "site int, period int, a double, b double, target double")
    samples = history_windows(panel, ["site"], "period", ["a", "b"], "target", [3])
    inputs = explode_history(samples, "history_3", 3, ["a", "b"], ["site", "period"])
    coefficients = spark.createDataFrame([(r, lag, f, c * lag) for r, c in (("r1", 1.5), ("r2", -0.5)) for f in "ab" for lag in (1, 2, 3)], "run string, lag int, feature string, coef double")
    background = inputs.where("period < 5").withColumn("value", F.when((F.col("lag") != 2) | (F.col("feature") != "a"), F.col("value")))
    long = op.linear_attribution(inputs, background, coefficients, ["site", "period"], keep_value=True)
    return long, op.nested_attribution(samples, "history_3", 3, ["a", "b"], background, coefficients, ["site", "period"])


def same(left, right, keys):
    def table(df):
        return {tuple(r[k] for k in keys): [r[c] for c in sorted(df.columns) if c not in keys] for r in df.collect()}

    a, b = table(left), table(right)
    assert a.keys() == b.keys() and a
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, abs=1e-12)


def test_nested_rows_hold_the_long_table(both):
    long, nested = both
    same(long, nested.select("run", "site", "period", "feature", F.inline("lags")), ["run", "site", "period", "feature", "lag"])


def test_projections_equal_the_grouped_totals(both):
    long, nested = both
    keys = ["run", "site", "period"]
    same(op.collapse_lags(long, keys), op.collapse_nested(nested, keys, 3), [*keys, "feature"])
    finite = nested.where("feature = 'a'")
    same(op.high_low_contrast(long.where("feature = 'a'"), ["run"], ["site", "period"]).drop("contrast_sign"), op.high_low_of(op.sample_levels(finite, keys), ["run"]).drop("contrast_sign"), ["run", "feature"])


def test_no_sample_is_a_group_of_a_shuffle(spark):
    """Sums over a sample's lags are projections: no aggregate or exchange on the sample's key."""
    for name in ("i01_collapse_lags", "i06_high_low_contrast", "i19_cross_check"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate [" in line and "period#" in line.split("]")[0] for line in plan.splitlines()), name
