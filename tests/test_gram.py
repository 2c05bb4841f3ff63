import numpy as np
import pytest

from panelwright.operators import gram


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    return [(i, int(f), int(y), [float(v) for v in rng.normal(size=3) + 4], float(rng.normal())) for i, (f, y) in enumerate((f, y) for f in range(3) for y in range(5) for _ in range(12))]


def direct(rows, alpha):
    x, y = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    xc = x - x.mean(axis=0)
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean()))
    return np.append(y.mean() - x.mean(axis=0) @ b, b)


def test_nested_ridge_equals_a_direct_solve_per_fold(spark, rows):
    df = spark.createDataFrame(rows, "i int, fold int, year int, f array<double>, y double").repartition(4)
    grams = gram.gram_table(df, "f", "y", ["fold", "year"])
    alphas, train = [0.1, 5.0, 1e4], {1: [0, 1, 2], 2: [0, 2]}
    scores, fits = gram.nested_ridge(grams, "fold", "year", [0, 1, 2], train, [3], alphas)
    for f in range(3):
        val = [r for r in rows if r[1] != f and r[2] == 3]
        tried = {(v, a): direct([r for r in rows if r[1] != f and r[2] in years], a) for v, years in train.items() for a in alphas}
        mse = {k: np.mean([(b[0] + np.dot(r[3], b[1:]) - r[4]) ** 2 for r in val]) for k, b in tried.items()}
        best = min(alphas, key=lambda a: np.mean([mse[v, a] for v in train]))
        for v in train:
            np.testing.assert_allclose(fits[f, v], tried[v, best], atol=1e-9)
            (found,) = [s for s in scores if s[:2] == (f, v)]
            assert found[2] == best and found[3] == pytest.approx(mse[v, best])
    got = gram.predict_levels(df.where("year = 4"), "f", "fold", fits, ["i"], "variant").collect()
    assert len(got) == 36 * 2
    for r in got:
        row = rows[r["i"]]
        assert r["y_pred"] == pytest.approx(fits[row[1], r["variant"]][0] + np.dot(row[3], fits[row[1], r["variant"]][1:]))


def test_blocks_without_rows_and_levels_without_fits(spark, rows):
    df = spark.createDataFrame(rows[:5], "i int, fold int, year int, f array<double>, y double")
    with pytest.raises(ValueError):
        gram.gram_table(df, "f", "y", ["fold"]).total(lambda fold: fold == 9)
    assert gram.predict_levels(df, "f", "fold", {(7, "a"): np.zeros(4)}, ["i"], "variant").count() == 0
