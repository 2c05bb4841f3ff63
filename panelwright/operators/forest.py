"""Regression forests whose work grows with rows x trees x depth.

Features become ranks among at most 255 thresholds, quantiles from Spark's sketch with a rank error of 0.002. Nodes of more than `block` rows are split by passes over all rows: tasks
add histograms per node, tasks choose the splits, and the driver sees one row a node. Smaller nodes become blocks: their
rows are shuffled once, with the validation rows that fall into them, and one task grows the whole subtree of a block and
predicts those rows. No task sees more training rows than a block has, no model is collected, and a tree's nodes cost no
further pass. Bootstrap weights and the features a node may use are hashes of (seed, tree) and of the row or the node, so
that with the same thresholds a forest depends neither on partitions nor on the size of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.gram import rows_to_matrix
from panelwright.session import cut_lineage

BINS = 256
#: Training rows a task may hold for one subtree.
BLOCK = 100_000
#: Gains that differ by less are equal, whatever order their sums were added up in: the first feature and bin win.
NEAR = 1.0 - 1e-9
#: P(weight <= k) of a Poisson weight with mean 1.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_hash(seed: int, tree: int) -> np.ndarray:
    return mix(mix(np.array([seed], np.uint64)) + np.uint64(tree))


def weights(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds each row."""
    u = mix(mix(ids.astype(np.uint64)) ^ tree_hash(seed, tree)) >> np.uint64(11)
    return np.searchsorted(POISSON, u * 2.0**-53, side="right")


def usable(nodes: np.ndarray, width: int) -> np.ndarray:
    """(nodes, ceil(sqrt(width))) features a node may be split by."""
    many = int(np.ceil(np.sqrt(width)))
    keys = mix(nodes[:, None] ^ mix(np.arange(1, width + 1, dtype=np.uint64))[None, :])
    return np.argsort(keys, axis=1, kind="stable")[:, :many]


def children(nodes: np.ndarray) -> np.ndarray:
    """Hashes of the left and right children, one after another."""
    return np.column_stack([mix(nodes ^ np.uint64(1)), mix(nodes ^ np.uint64(2))]).ravel()


def _best_splits(x: np.ndarray, w: np.ndarray, r: np.ndarray, at: np.ndarray, allowed: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) per node; `r` are weighted residuals from the node's mean, every node has rows."""
    k = len(allowed)
    total, gain, feature, cut = np.bincount(at, w, k), np.zeros(k), np.zeros(k, int), np.zeros(k, int)
    rows = np.arange(len(at))
    for j in range(allowed.shape[1]):
        key = at * BINS + x[rows, allowed[at, j]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
        node = key[ends] // BINS
        first = np.searchsorted(node, np.arange(k))
        n, s = np.cumsum(w[order])[ends], np.cumsum(r[order])[ends]
        last = np.append(first[1:], len(node)) - 1
        n0, s0 = np.concatenate([[0], n[last][:-1]]), np.concatenate([[0.0], s[last][:-1]])
        n, s = n - n0[node], s - s0[node]
        rest = total[node] - n
        ok = (n >= leaf) & (rest >= leaf)
        g = np.where(ok, s * s * (1.0 / np.maximum(n, 1) + 1.0 / np.maximum(rest, 1)), 0.0)
        top = np.maximum.reduceat(g, first)
        hits = np.flatnonzero(g >= top[node] * NEAR)
        place = hits[np.searchsorted(node[hits], np.arange(k))]
        better = top * NEAR > gain
        gain[better], feature[better], cut[better] = top[better], allowed[better, j], (key[ends] % BINS)[place][better]
    return gain, feature, cut


def grow(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, new: np.ndarray, node: int, depth: int, depths: Sequence[int], leaf: int
) -> np.ndarray:
    """(rows of `new`, depths): predictions of the subtree below `node`, grown level by level on (x, y, w).

    Column j is the tree cut off at depths[j]; those above `depth` are left NaN.
    """
    out = np.full((len(new), len(depths)), np.nan)
    at, into, rows = np.zeros(len(x), int), np.zeros(len(new), int), np.arange(len(new))
    nodes = np.array([node], np.uint64)
    while len(x):
        k = len(nodes)
        n = np.bincount(at, w, k)
        mean = np.bincount(at, w * y, k) / n
        for j, d in enumerate(depths):
            if depth <= d:
                out[rows, j] = mean[into]
        if depth >= max(depths):
            break
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, at, y)
        np.maximum.at(high, at, y)

        def keep(chosen: np.ndarray) -> None:
            nonlocal x, y, w, at, into, rows, new, nodes
            number = np.cumsum(chosen) - 1
            mine, theirs = chosen[at], chosen[into]
            x, y, w, at = x[mine], y[mine], w[mine], number[at[mine]]
            new, rows, into = new[theirs], rows[theirs], number[into[theirs]]
            nodes = nodes[chosen]

        open_ = (n >= 2 * leaf) & (low < high)
        keep(open_)
        if not len(x):
            break
        gain, feature, cut = _best_splits(x, w, w * (y - mean[open_][at]), at, usable(nodes, x.shape[1]), leaf)
        split = gain > 0
        keep(split)
        feature, cut = feature[split], cut[split]
        at = 2 * at + (x[np.arange(len(at)), feature[at]] > cut[at])
        into = 2 * into + (new[np.arange(len(into)), feature[into]] > cut[into])
        nodes, depth = children(nodes), depth + 1
    return out


@dataclass
class Top:
    """The part of one tree that is split by passes over all rows; a node without children is a block or a leaf."""

    tree: int
    leaf: int
    hashes: list[int]
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    mean: list[float] = field(default_factory=lambda: [float("nan")])
    grown: list[bool] = field(default_factory=lambda: [False])

    def route(self, x: np.ndarray, depths: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(node, means of the nodes above at `depths`) of every row."""
        at, early = np.zeros(len(x), int), np.full((len(x), len(depths)), np.nan)
        feature, cut, left, mean = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.mean)
        for level in range(max(self.depth) + 1):
            inner = feature[at] >= 0
            for j, d in enumerate(depths):
                if d == level:
                    early[inner, j] = mean[at[inner]]
            here = at[inner]
            at[inner] = left[here] + (x[inner, feature[here]] > cut[here])
        return at, early


def _cells(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, width)


def _binned(df: DataFrame, features: str, target: str, keys: Sequence[str], thresholds: list[np.ndarray], held: bool) -> DataFrame:
    ident = F.xxhash64(*keys) if keys and not held else F.monotonically_increasing_id()
    rows = df.select(ident.alias("id"), F.col(target).cast("double").alias("y"), F.col(features).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = rows_to_matrix(batch.column("x"))
                b = np.column_stack([np.searchsorted(t, m[:, i]) for i, t in enumerate(thresholds)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([r.tobytes() for r in b], pa.binary())], names=["id", "y", "x"])

    return rows.mapInArrow(run, "id long, y double, x binary").withColumn("held", F.lit(held))


def _split_open(rows: DataFrame, tops: list[Top], open_: list[tuple[int, int]], width: int, seed: int) -> dict[int, tuple]:
    """Per open node, numbered as in `open_`: rows, mean, gain, feature, bin, rows and mean on the left and on the right.

    A task holds one histogram per open node; there are at most some (rows x trees) / (block / 2) of those.
    """
    allowed = usable(np.array([tops[t].hashes[n] for t, n in open_], np.uint64), width)
    many, leaves = allowed.shape[1], [tops[t].leaf for t, _ in open_]
    slots = [np.full(len(top.feature), -1) for top in tops]
    for i, (t, n) in enumerate(open_):
        slots[t][n] = i

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(open_) * many * BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, ids = _cells(batch, width), batch.column("y").to_numpy(), batch.column("id").to_numpy()
            for top, slot in zip(tops, slots):
                at, w = slot[top.route(x)[0]], weights(ids, seed, top.tree)
                mine = np.flatnonzero((at >= 0) & (w > 0))
                a, w, values = at[mine], w[mine], y[mine]
                for j in range(many):
                    key = (a * many + j) * BINS + x[mine, allowed[a, j]]
                    np.add.at(sums[0], key, w)
                    np.add.at(sums[1], key, w * values)
        sums = sums.reshape(2, len(open_), many * BINS)
        for i in np.flatnonzero(sums[0].any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums[:, i].ravel()], pa.list_(pa.float64()))], names=["slot", "sums"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        n, s = sum(c.values.to_numpy() for c in table.column("sums")).reshape(2, many, BINS)
        total, mean = n[0].sum(), s[0].sum() / n[0].sum()
        ln, ls = np.cumsum(n, axis=1), np.cumsum(s - n * mean, axis=1)
        rn = total - ln
        ok = (ln >= leaves[i]) & (rn >= leaves[i])
        g = np.where(ok, ls * ls * (1.0 / np.maximum(ln, 1) + 1.0 / np.maximum(rn, 1)), 0.0)
        j = 0
        for other in range(1, many):
            j = other if g[other].max() * NEAR > g[j].max() else j
        b = int(np.argmax(g[j] >= g[j].max() * NEAR))
        found = [i, total, mean, g[j, b], allowed[i, j], b, ln[j, b]]
        return pa.table([pa.array([v], t) for v, t in zip(found, (pa.int32(), *[pa.float64()] * 3, pa.int32(), pa.int32(), pa.float64()))], names=names)

    names = ["slot", "n", "mean", "gain", "feature", "bin", "n_left"]
    parts = rows.select("id", "y", "x").mapInArrow(count, "slot int, sums array<double>")
    found = parts.groupBy("slot").applyInArrow(choose, "slot int, n double, mean double, gain double, feature int, bin int, n_left double")
    return {r["slot"]: r for r in found.collect()}  # one row per node of more than a block


def forest_predictions(
    train: DataFrame, validation: DataFrame, features: str, target: str, trees: int, depths: Sequence[int], leaves: Sequence[int], seed: int,
    keys: Sequence[str] = (), block: int = BLOCK,
) -> DataFrame:
    """(id, y_true, leaf, tree, p): every validation row's predictions by every tree, one per depth in `p`.

    Trees of one number share their bootstrap sample, whatever their leaves; a shallower tree is a deeper one cut off.
    `keys` name a training row, so that its weights do not depend on partitions. Rows without a target train nothing.
    """
    train = train.where(F.col(target).isNotNull())
    head = train.select(F.size(features).alias("n")).first()
    if head is None:
        raise ValueError("no training rows")
    width, depths = head["n"], list(depths)
    columns = [f"f{i}" for i in range(width)]
    cuts = train.select(*[F.get(features, F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)]).approxQuantile(columns, [i / BINS for i in range(BINS - 1)], 0.002)
    thresholds = [np.unique(c) for c in cuts]
    rows = cut_lineage(_binned(train, features, target, keys, thresholds, False).unionByName(_binned(validation, features, target, keys, thresholds, True)))
    learnt = rows.where(~F.col("held"))
    tops = [Top(t, leaf, [int(tree_hash(seed, t)[0])]) for t in range(trees) for leaf in leaves]
    size = learnt.count()
    open_ = [(i, 0) for i in range(len(tops))] if size > block else []
    while open_:
        found, after = _split_open(learnt, tops, open_, width, seed), []
        for i, (t, n) in enumerate(open_):
            r, top = found[i], tops[t]
            top.mean[n], top.grown[n] = r["mean"], True
            if r["gain"] > 0 and top.depth[n] < max(depths):
                top.feature[n], top.cut[n], top.left[n] = r["feature"], r["bin"], len(top.feature)
                for h, rest in zip(children(np.array([top.hashes[n]], np.uint64)), (r["n_left"], r["n"] - r["n_left"])):
                    if rest > block:
                        after.append((t, len(top.feature)))
                    for column, value in ((top.hashes, int(h)), (top.feature, -1), (top.cut, 0), (top.left, -1), (top.depth, top.depth[n] + 1), (top.mean, float("nan")), (top.grown, False)):
                        column.append(value)
        open_ = after
    starts = np.cumsum([0, *[len(t.feature) for t in tops]])
    schema = pa.schema([("block", pa.int32()), ("id", pa.int64()), ("y", pa.float64()), ("x", pa.binary()), ("w", pa.int32()), ("early", pa.list_(pa.float64()))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, held, ids = _cells(batch, width), batch.column("held").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            for i, top in enumerate(tops):
                at, early = top.route(x, depths)
                leaf_means = np.array(top.mean)[at]
                grown = np.array(top.grown)[at]
                for j, d in enumerate(depths):  # leaves of the upper part answer at once
                    open_here = grown & np.isnan(early[:, j])
                    early[open_here, j] = leaf_means[open_here]
                w = np.where(held, 0, weights(ids, seed, top.tree)).astype(np.int32)
                kept = np.flatnonzero(held | ((w > 0) & ~grown))
                take = pa.array(kept)
                yield pa.RecordBatch.from_arrays([
                    pa.array((starts[i] + at[kept]).astype(np.int32)), batch.column("id").take(take), batch.column("y").take(take), batch.column("x").take(take),
                    pa.array(w[kept]), pa.array(list(early[kept]), pa.list_(pa.float64())),
                ], schema=schema)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        i = int(np.searchsorted(starts, number, side="right")) - 1
        top, n = tops[i], number - int(starts[i])
        x, w = _cells(table, width), table.column("w").to_numpy()
        mine, asked = w > 0, w == 0
        chosen = table.filter(pa.array(asked))
        p = rows_to_matrix(chosen.column("early").combine_chunks()) if len(chosen) else np.zeros((0, len(depths)))
        if mine.any() and len(chosen):
            order = np.argsort(table.column("id").to_numpy()[mine], kind="stable")  # sums in one order, wherever rows came from
            q = grow(x[mine][order], table.column("y").to_numpy(zero_copy_only=False)[mine][order], w[mine][order].astype(float), x[asked], top.hashes[n], top.depth[n], depths, top.leaf)
            p = np.where(np.isnan(p), q, p)
        size = len(chosen)
        return pa.table([
            chosen.column("id"), chosen.column("y"), pa.array(np.full(size, top.leaf, np.int32)), pa.array(np.full(size, top.tree, np.int32)), pa.array(list(p), pa.list_(pa.float64())),
        ], names=["id", "y_true", "leaf", "tree", "p"])

    blocks = sum(f < 0 for t in tops for f in t.feature)
    sent = rows.mapInArrow(spread, "block int, id long, y double, x binary, w int, early array<double>")
    # a block is minutes of work on few bytes, so their number sets the number of tasks
    return sent.repartition(2 * blocks, "block").groupBy("block").applyInArrow(finish, "id long, y_true double, leaf int, tree int, p array<double>")
