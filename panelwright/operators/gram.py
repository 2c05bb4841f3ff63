"""Linear models from sums: one pass yields Gram matrices per block of rows, and every fit and score is algebra on them.

A block is a combination of levels, such as (fold, year). The matrix of any union of blocks is the sum of theirs, so the
training rows of every fold, with or without a year, and all penalties need no further pass and no copies of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GramTable:
    """Augmented Gram matrices of [1, x, y] per block; `names` are the levels of a block's key."""

    names: tuple[str, ...]
    blocks: dict[tuple, np.ndarray]

    def total(self, keep: Callable[..., bool] = lambda **_: True) -> np.ndarray:
        """Sum over the blocks whose levels, given by name, are kept."""
        found = [g for key, g in self.blocks.items() if keep(**dict(zip(self.names, key)))]
        if not found:
            raise ValueError("no rows in the blocks asked for")
        return np.sum(found, axis=0)


def rows_to_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long arrays of doubles as a matrix, without objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that what is made of a batch of matrices stays small; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gram_table(df: DataFrame, features: str, target: str, by: Sequence[str]) -> GramTable:
    """One pass. A task adds up its rows per block; matrix cells are summed on Spark.

    The result has blocks x (columns + 2)^2 numbers, whatever the number of rows. Features and target must be complete.
    """
    rows = df.select(*by, F.col(features).cast("array<double>").alias("_x"), F.col(target).cast("double").alias("_y"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema] + ["_i int", "_row array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        fields = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fields = [pa.field(c, batch.schema.field(c).type) for c in by]
            x = rows_to_matrix(batch.column("_x"))
            z = np.column_stack([np.ones(len(x)), x, batch.column("_y").to_numpy(zero_copy_only=False)])
            levels = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * len(x)
            known = {k: i for i, k in enumerate(dict.fromkeys(levels))}
            code = np.fromiter((known[k] for k in levels), np.int64, len(levels))
            for k, i in known.items():
                part = z[code == i]
                acc[k] = acc.get(k, 0.0) + part.T @ part
        made = pa.schema([*fields, pa.field("_i", pa.int32()), pa.field("_row", pa.list_(pa.float64()))])
        for k, g in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(g), f.type) for v, f in zip(k, fields)] + [pa.array(range(len(g)), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))], schema=made)

    parts = rows.mapInArrow(run, schema).select(*by, "_i", F.posexplode("_row").alias("_j", "_v"))
    out: dict[tuple, dict] = {}
    for r in parts.groupBy(*by, "_i", "_j").agg(F.sum("_v").alias("_v")).collect():
        out.setdefault(tuple(r[c] for c in by), {})[r["_i"], r["_j"]] = r["_v"]
    return GramTable(tuple(by), {k: np.array([[g[i, j] for j in range(n)] for i in range(n)]) for k, g in out.items() for n in [round(len(g) ** 0.5)]})


def solve_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, coefficients]; the intercept is not penalised."""
    n, sx, sy = gram[0, 0], gram[0, 1:-1], gram[0, -1]
    xx = gram[1:-1, 1:-1] - np.outer(sx, sx) / n
    xy = gram[1:-1, -1] - sx * sy / n
    beta = np.linalg.solve(xx + alpha * np.eye(len(sx)), xy)
    return np.concatenate([[(sy - sx @ beta) / n], beta])


def mean_square(gram: np.ndarray, beta: np.ndarray) -> float:
    """Mean squared error of [intercept, coefficients] on the rows of a Gram matrix."""
    v = np.append(beta, -1.0)
    return float(v @ gram @ v / gram[0, 0])


def nested_ridge(
    grams: GramTable, fold: str, block: str, folds: Sequence, train: Mapping[object, Sequence], validation: Sequence, alphas: Sequence[float]
) -> tuple[list[tuple], dict[tuple, np.ndarray]]:
    """Ridge as a candidate of nested selection: ((fold, variant, alpha, mse) rows, {(fold, variant): coefficients}).

    For a held-out fold, a variant trains on the other folds' rows in its blocks; each penalty is scored on the other
    folds' validation blocks. The fold's penalty has the lowest mean score over its variants, of ties the first one.
    """
    scores, chosen = [], {}
    for f in folds:
        held = grams.total(lambda **k: k[fold] != f and k[block] in validation)
        sums = {v: grams.total(lambda **k: k[fold] != f and k[block] in blocks) for v, blocks in train.items()}
        betas = {v: [solve_ridge(g, a) for a in alphas] for v, g in sums.items()}
        mse = np.array([[mean_square(held, b) for b in betas[v]] for v in train])
        best = int(np.argmin(mse.mean(axis=0)))
        for i, v in enumerate(train):
            scores.append((f, v, float(alphas[best]), float(mse[i, best])))
            chosen[f, v] = betas[v][best]
    return scores, chosen


def predict_levels(df: DataFrame, features: str, level: str, coefficients: Mapping[tuple, np.ndarray], keep: Sequence[str], variant: str) -> DataFrame:
    """(keep, variant, y_pred): every row with the coefficients of its level, once per variant of that level.

    `coefficients` maps (level, variant) to [intercept, coefficients]: model-sized, sent to the tasks with the function.
    Rows of a level without coefficients give none.
    """
    by: dict[object, dict[object, np.ndarray]] = {}
    for (k, v), beta in coefficients.items():
        by.setdefault(k, {})[v] = beta
    rows = df.select(*keep, F.col(level).alias("_level"), F.col(features).cast("array<double>").alias("_x"))
    head = rows.select(*keep).schema
    kinds = {type(v) for _, v in coefficients}
    kind, arrow = ("int", pa.int32()) if kinds <= {int} else ("string", pa.string())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + f", `{variant}` {kind}, y_pred double"
    names = [*keep, variant, "y_pred"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, levels = rows_to_matrix(batch.column("_x")), np.array(batch.column("_level").to_pylist(), object)
            for k in dict.fromkeys(levels.tolist()):
                at = np.flatnonzero(levels == k)
                part = batch.select(list(keep)).take(pa.array(at))
                for v, beta in by.get(k, {}).items():
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v] * len(at), arrow), pa.array(x[at] @ beta[1:] + beta[0])], names=names)

    return rows.mapInArrow(run, schema)
