import numpy as np
import pytest

from panelwright.operators import agreement
from panelwright.operators import inversions as op


def brute(x, y, w):
    return sum(int(w[i]) * int(w[j]) for i in range(len(x)) for j in range(len(x)) if x[i] < x[j] and y[i] > y[j])


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_inversions_of_a_sequence(n):
    rng = np.random.default_rng(n)
    y, w = rng.integers(0, 12, n).astype(float), rng.integers(1, 5, n)
    assert op.weighted_inversions(y, w) == brute(np.arange(n), y, w)


@pytest.mark.parametrize("limit", [11, 1 << 20])
def test_rounds_of_chunks(spark, limit):
    rng = np.random.default_rng(2)
    data = {g: (np.where(rng.random(n) < 0.4, 3, rng.integers(-9, 30, n)), np.where(rng.random(n) < 0.4, 5, rng.integers(-30, 9, n)), rng.integers(1, 4, n)) for g, n in (("a", 240), ("b", 30), ("c", 1))}
    data["d"] = (np.arange(80), -np.arange(80), np.full(80, 10**7))  # all falling
    data["e"] = (np.arange(80), np.full(80, 4), np.ones(80))
    rows = [(g, float(a), float(b), int(c)) for g, v in data.items() for a, b, c in zip(*v)] + [(None, 1.0, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w long").repartition(6)
    got = {r["g"]: int(r["inversions"]) for r in op.count_inversions(df, ["g"], "x", "y", "w", limit).collect()}
    assert got == {g: brute(*v) for g, v in data.items()}
    alone = op.count_inversions(df.where("g = 'a'"), [], "x", "y", "w", limit).first()["inversions"]
    assert int(alone) == got["a"]


def test_kendall_with_a_hot_value_and_ties(spark, monkeypatch):
    monkeypatch.setattr("panelwright.operators.inversions.count_inversions.__defaults__", (7,))
    rng = np.random.default_rng(3)
    rows = [(k % 3, k, float(0 if rng.random() < 0.35 else rng.integers(0, 40)), float(1 if rng.random() < 0.35 else rng.integers(0, 40))) for k in range(400)]
    df = spark.createDataFrame([*rows, (0, 999, None, 1.0), (None, 1000, 1.0, 1.0)], "g int, k int, x double, y double").repartition(5)
    one = {r["g"]: (r["n"], r["kendall"]) for r in agreement.kendall_tau_b(df, "x", "y", ["g"], ["k"]).collect()}
    two = {r["g"]: (r["n"], r["kendall"]) for r in agreement.kendall_tau_b(df.where("g is not null"), "x", "y", ["g"], ["k"], bounded=True).collect()}
    assert one.keys() == two.keys() and all(one[g] == pytest.approx(two[g], abs=1e-12) for g in one)
    flat = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], "k int, x double, y double")
    assert agreement.kendall_tau_b(flat, "x", "y", [], ["k"]).first()["kendall"] is None
