import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ordering as op


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one group, and one value is very frequent."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 7}"
        v = 0.0 if i % 4 == 0 else float(np.round(rng.normal(), 3))
        rows.append((i, g, v))
    rows.append((3000, "hot", None))
    return rows, spark.createDataFrame(rows, "id long, g string, v double")


@pytest.mark.parametrize("bounded", [True, False])
def test_running_sum_is_exact_within_groups(skewed, bounded):
    rows, df = skewed
    got = {r["id"]: r["c"] for r in op.running_sum(df.where("v is not null"), 1, ["v", "id"], "c", ["g"], bounded).collect()}
    for g in {r[1] for r in rows}:
        ordered = sorted((r[2], r[0]) for r in rows if r[1] == g and r[2] is not None)
        for k, (_, i) in enumerate(ordered, 1):
            assert got[i] == k


def test_dense_index_is_global_and_partition_free(skewed):
    _, df = skewed
    for parts in (1, 5):
        got = [r["i"] for r in op.dense_index(df.repartition(parts), ["id"], "i").orderBy("id").collect()]
        assert got == list(range(3001))


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("ties", ["average", "min"])
def test_average_rank(skewed, bounded, ties):
    rows, df = skewed
    got = {r["id"]: r["rank"] for r in op.average_rank(df.where("v is not null"), "v", by=["g"], ties=ties, bounded=bounded).collect()}
    for i, g, v in rows[:200]:
        peers = [x[2] for x in rows if x[1] == g and x[2] is not None]
        less, same = sum(p < v for p in peers), sum(p == v for p in peers)
        assert got[i] == pytest.approx(less + 1 if ties == "min" else less + (same + 1) / 2)


@pytest.mark.parametrize("digits", [4, 65_536])
def test_exact_quantiles_match_numpy(skewed, digits):
    """Few digits make many passes."""
    rows, df = skewed
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}
    out = op.exact_quantiles(df, "v", probs, ["g"], digits=digits).collect()
    assert len(out) == len({r[1] for r in rows})
    for r in out:
        values = np.array([x[2] for x in rows if x[1] == r["g"] and x[2] is not None])
        assert r["n"] == len(values)
        for k, p in probs.items():
            assert r[k] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("digits", [4, 65_536])
def test_inverse_cdf_quantiles(skewed, digits):
    rows, df = skewed
    values = np.array([x[2] for x in rows if x[2] is not None])
    r = op.exact_quantiles(df, "v", {"a": 0.25, "b": 0.75}, inverse_cdf=True, digits=digits).first()
    assert r["a"] == np.quantile(values, 0.25, method="inverted_cdf")
    assert r["b"] == np.quantile(values, 0.75, method="inverted_cdf")


@pytest.mark.parametrize("digits", [2, 65_536])
def test_quantiles_of_hard_columns(spark, digits):
    """Subnormals, neighbours in the last bit, huge ranges, infinities, NaN, a null group and a group of nulls."""
    tight = [1.0 + i * 2.0**-52 for i in range(40)] + [1e300, -1e300, 5e-324, -5e-324, 0.0, -0.0]
    wide = [float("-inf"), -1.5, 2.0, float("inf"), float("nan")]
    rows = [("tight", v) for v in tight] + [(None, v) for v in wide] + [("none", None)]
    probs = {f"p{i}": i / 20 for i in range(21)}
    out = {r["g"]: r for r in op.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", probs, ["g"], inverse_cdf=True, digits=digits).collect()}
    assert set(out) == {"tight", None}
    for group, values in (("tight", tight), (None, wide)):
        ordered = sorted(values, key=lambda v: (v != v, v if v == v else 0.0))
        assert out[group]["n"] == len(values)
        for k, p in probs.items():
            want = ordered[max(0, int(np.ceil(len(values) * p - 1e-9)) - 1)]
            assert out[group][k] == want or (want != want and out[group][k] != out[group][k])


def test_quantiles_of_an_empty_column(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert [tuple(r) for r in op.exact_quantiles(empty, "v", {"a": 0.5}).collect()] == [(None, None)]
    assert op.exact_quantiles(empty.withColumn("g", F.lit(1)), "v", {"a": 0.5}, ["g"]).collect() == []


def test_value_counts_with_weights(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (3.0, 0), (3.0, 1)], "v double, w int")
    got = {r["v"]: (r["n"], r["n_before"]) for r in op.value_counts(df, "v", weight=F.col("w")).collect()}
    assert got == {1.0: (1, 0), 2.0: (1, 1), 3.0: (1, 2)}
