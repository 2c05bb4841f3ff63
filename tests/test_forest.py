import numpy as np
import pytest

from panelwright.operators import forest
from panelwright.operators import modelling as op


def by_rows(x, y, w, v, node, depth, limit, leaf):
    """A tree's prediction of one row, node by node."""
    mean = (w * y).sum() / w.sum()
    if depth == limit or w.sum() < 2 * leaf or y.min() == y.max():
        return mean
    best = (0.0, None, None)
    for f in forest.usable(np.array([node], np.uint64), x.shape[1])[0]:
        for b in np.unique(x[:, f]):
            left = x[:, f] <= b
            n, m = w[left].sum(), w[~left].sum()
            if n >= leaf and m >= leaf:
                s = (w * (y - mean))[left].sum()
                gain = s * s * (1 / n + 1 / m)
                if gain * forest.NEAR > best[0]:
                    best = (gain, f, b)
    if best[1] is None:
        return mean
    side = int(v[best[1]] > best[2])
    mine = (x[:, best[1]] > best[2]) == bool(side)
    return by_rows(x[mine], y[mine], w[mine], v, int(forest.children(np.array([node], np.uint64))[side]), depth + 1, limit, leaf)


@pytest.mark.parametrize("leaf", [1, 3])
def test_subtree_equals_one_grown_node_by_node(leaf):
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 12, (150, 5)).astype(np.uint8), rng.normal(size=150), rng.integers(1, 4, 150).astype(float)
    new = rng.integers(0, 12, (40, 5)).astype(np.uint8)
    got = forest.grow(x, y, w, new, 77, 0, [2, 30], leaf)
    for j, limit in enumerate((2, 30)):
        assert got[:, j] == pytest.approx([by_rows(x, y, w, v, 77, 0, limit, leaf) for v in new], abs=1e-9)


def test_grid_depends_neither_on_blocks_nor_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(0, 40, 4)], float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, f array<double>, y double")

    def grid(parts, block):
        got = op.random_forest_grid(df.repartition(parts), df, "f", "y", [2, 3], [None, 4], [1, 3], keys=["k"], block=block).collect()
        return {(r["n_estimators"], r["max_depth"], r["min_samples_leaf"]): (r["n"], round(r["rmse"], 9)) for r in got}

    whole = grid(1, 100_000)
    assert len(whole) == 8 and all(n == 600 for n, _ in whole.values()) and len({v for _, v in whole.values()}) == 8
    assert grid(7, 100_000) == whole and grid(5, 90) == whole
