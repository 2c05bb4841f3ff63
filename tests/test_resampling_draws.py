import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import resampling as op


@pytest.mark.parametrize("n", [1, 7, 256, 257, 1000])
def test_split_draws_add_up_and_repeat(n):
    parts = [op.split_counts(n, b, 40, 3) for b in range(-(-n // op.LEAF))]
    counts = np.concatenate(parts, axis=1)
    assert counts.shape == (40, n) and (counts.sum(axis=1) == n).all()
    assert (op.split_counts(n, 0, 40, 3) == parts[0]).all() and (n == 1 or (op.split_counts(n, 0, 40, 4) != parts[0]).any())


def test_split_draws_are_multinomial():
    n, reps = 12, 20_000
    counts = np.concatenate([op.split_counts(n, b, reps, 9, leaf=5) for b in range(3)], axis=1)
    cov = np.cov(counts.T)
    assert np.abs(counts.mean(axis=0) - 1).max() < 0.03
    assert np.abs(np.diag(cov) - (1 - 1 / n)).max() < 0.05
    assert np.abs(cov[~np.eye(n, dtype=bool)] + 1 / n).max() < 0.03
    # one cluster's count is binomial(n, 1 / n)
    found = np.bincount(counts[:, 6], minlength=5)[:5] / reps
    want = [np.prod(np.arange(n, n - k, -1)) / np.prod(np.arange(1, k + 1)) * (1 / n) ** k * (1 - 1 / n) ** (n - k) for k in range(5)]
    assert np.abs(found - want).max() < 0.01


@pytest.mark.parametrize("draws", ["hash", "split"])
@pytest.mark.parametrize("stratum", [[], ["s"]])
def test_weighted_sums_equal_drawing_clusters(spark, monkeypatch, draws, stratum):
    monkeypatch.setattr(op, "HELD", 50)
    rng = np.random.default_rng(5)
    rows = [(c, c % 2, f"m{k}", float(rng.normal()), float(rng.integers(1, 5))) for c in range(30) for k in range(3) if (c + k) % 7]
    df = spark.createDataFrame(rows, "c int, s int, m string, x double, k double").repartition(4)
    counts = {(r["rep"], r["c"]): r["multiplicity"] for r in op.multiplicities(df.select("c", "s").distinct(), ["c"], 9, 11, stratum, draws).collect()}
    sizes = {s: len({r[0] for r in rows if r[1] == s}) for s in (0, 1)}
    for rep in range(1, 10):
        per = {s: sum(v for (p, c), v in counts.items() if p == rep and c % 2 == s) for s in (0, 1)}
        assert per == sizes if stratum else sum(per.values()) == 30
    want = {}
    for c, s, m, x, k in rows:
        for rep in range(1, 10):
            w = counts.get((rep, c), 0)
            if w:
                key = (s,) * len(stratum) + (rep, m)
                a, b = want.get(key, (0.0, 0.0))
                want[key] = (a + w * x, b + w * k)
    got = {tuple(r[c] for c in (*stratum, "rep", "m")): (r["x"], r["k"]) for r in op.replicate_sums(df, ["c"], ["x", "k"], 9, 11, ["m"], stratum, draws).collect()}
    assert got.keys() == want.keys()
    for key, (x, k) in want.items():
        assert got[key] == pytest.approx((x, k))


def test_split_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(600).select(F.col("id").alias("c"))
    a, b = (op.multiplicities(df.repartition(p), ["c"], 20, 1, draws="split") for p in (2, 9))
    assert a.exceptAll(b).count() == 0 and a.agg(F.sum("multiplicity")).first()[0] == 600 * 20
