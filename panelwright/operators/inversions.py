"""Inversions of weighted points: pairs where x rises and y falls, counted without forming pairs.

Points are laid out by range of (x, y) once. A task cuts what it holds into chunks, counts inside each, and emits the
chunk's profile: its weights per y. Profiles are laid out by range of y; a task cuts them into buckets, never inside one
y, and counts pairs of different chunks inside each bucket. What is left are pairs of different chunks and different
buckets, and those are inversions of the far fewer points (chunk, bucket, weight): the same problem again, until every
group is one chunk. A chunk has at most `CHUNK` rows, whatever the sizes of partitions, groups or hot values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import broadcast_if_small, cut_lineage

CHUNK = 1 << 20


def weighted_inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_i * w_j over i < j with y_i > y_j.

    Two ranks first differ in one binary digit: at each digit, among rows that share the higher ones, a row with digit 0
    forms inversions with the rows before it that have digit 1.
    """
    _, rank = np.unique(y, return_inverse=True)
    rank, w, total = rank.astype(np.int64), w.astype(np.int64), 0
    for b in range(int(rank.max()).bit_length() - 1 if len(rank) else -1, -1, -1):
        high, one = rank >> (b + 1), (rank >> b) & 1 == 1
        ones = np.cumsum(np.where(one, w, 0))
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        before = np.concatenate([[0], ones])[first]
        zero = ~one
        total += int(np.dot(w[zero], (ones - np.repeat(before, np.diff(np.append(first, len(high)))))[zero]))
        order = np.argsort(rank >> b, kind="stable")
        rank, w = rank[order], w[order]
    return total


def _chunks(batches: Iterator[pa.RecordBatch], by: Sequence[str], limit: int, whole: str | None = None) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(group, columns) of consecutive rows of one group, some `limit` rows at most; rows with equal `whole` stay together."""
    held: list[tuple] = []
    group: tuple = ()

    def release() -> tuple[tuple, dict[str, np.ndarray]]:
        out = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        held.clear()
        return group, out

    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in by}
        keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[a] != group:
                yield release()
            group, at = keys[a], a
            while at < b:
                size = sum(len(next(iter(h.values()))) for h in held)
                if size >= limit and (whole is None or held[-1][whole][-1] != columns[whole][at]):
                    yield release()
                    size = 0
                stop = min(b, at + max(limit - size, 1))
                if whole is not None:  # on to the end of the last value, or of the batch
                    stop = min(b, at + int(np.searchsorted(columns[whole][at:b], columns[whole][stop - 1], "right")))
                held.append({c: v[at:stop] for c, v in columns.items()})
                at = stop
    if held:
        yield release()


def count_inversions(points: DataFrame, by: Sequence[str], x: str, y: str, weight: str, limit: int = CHUNK) -> DataFrame:
    """(by, inversions) per group; numbers must be finite, rows of null groups are left out.

    Pairs with equal x or equal y do not count. Each round moves a row at most twice; a group of n rows leaves at most
    (n / limit)^2 points to the next round, whose chunks are four times as large, so that rounds end whatever the limit.
    """
    for c in by:
        points = points.where(F.col(c).isNotNull())
    points = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(weight).cast("long").alias("_w"))
    heads = [f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by).schema]
    schema = ", ".join([*heads, "_p double", "_y double", "_w long", "_inv decimal(38,0)"])

    def rows(group: tuple, types: list, p: float, ys: np.ndarray, ws: np.ndarray, ps: np.ndarray | None, count: int) -> pa.RecordBatch:
        import decimal

        n = len(ys)
        cells = [pa.array([v] * (n + 1), t) for v, t in zip(group, types)]
        place = np.append(np.full(n, p) if ps is None else ps, p)
        return pa.RecordBatch.from_arrays([
            *cells, pa.array(place), pa.array([*ys.tolist(), None], pa.float64()), pa.array([*ws.tolist(), None], pa.int64()),
            pa.array([None] * n + [decimal.Decimal(count)], pa.decimal128(38, 0)),
        ], names=[*by, "_p", "_y", "_w", "_inv"])

    def numbered() -> Iterator[float]:
        from pyspark import TaskContext

        base, i = TaskContext.get().partitionId() << 32, 0
        while True:
            yield float(base + i)
            i += 1

    def tracked(batches, types: list):
        for batch in batches:
            types[:] = [batch.schema.field(c).type for c in by]
            yield batch

    def inside(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        types: list = []
        for (group, c), p in zip(_chunks(tracked(batches, types), by, most), numbered()):
            ys, at = np.unique(c["_y"], return_inverse=True)
            ws = np.zeros(len(ys), np.int64)
            np.add.at(ws, at, c["_w"])
            yield rows(group, types, p, ys, ws, None, weighted_inversions(c["_y"], c["_w"]))

    def across(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        types: list = []
        for (group, c), q in zip(_chunks(tracked(batches, types), by, most, "_y"), numbered()):
            order = np.lexsort((c["_y"], c["_p"]))
            ps, at = np.unique(c["_p"], return_inverse=True)
            ws = np.zeros(len(ps), np.int64)
            np.add.at(ws, at, c["_w"])
            yield rows(group, types, q, np.full(len(ps), q), ws, ps, weighted_inversions(c["_y"][order], c["_w"][order]))

    found = []
    while True:
        laid = points.repartitionByRange(*by, "_x", "_y").sortWithinPartitions(*by, "_x", "_y").select(*by, "_y", "_w")
        local = cut_lineage(laid.mapInArrow(partial(inside, most=limit), schema))
        counts = local.where(F.col("_inv").isNotNull())
        found.append(counts.select(*by, "_inv"))
        cut = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1).drop("_k")  # at most one a chunk
        if not (cut.limit(1).count() if by else counts.limit(2).count() > 1):
            break
        profile = local.where(F.col("_y").isNotNull()).drop("_inv")
        profile = profile.join(broadcast_if_small(cut), list(by), "left_semi") if by else profile
        laid = profile.repartitionByRange(*by, "_y").sortWithinPartitions(*by, "_y", "_p").select(*by, "_p", "_y", "_w")
        buckets = cut_lineage(laid.mapInArrow(partial(across, most=limit), schema))
        found.append(buckets.where(F.col("_inv").isNotNull()).select(*by, "_inv"))
        points = buckets.where(F.col("_y").isNotNull()).select(*by, F.col("_p").alias("_x"), "_y", "_w")
        limit *= 4
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(*by).agg(F.sum("_inv").alias("inversions"))
