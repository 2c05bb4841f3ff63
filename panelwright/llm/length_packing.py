"""Packing: length buckets that minimise padding, chosen by dynamic programming, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.ranking import number_within
from panelwright.session import cut_lineage

BUCKETS = 16
#: Tokens of a batch after padding; a longer document is a batch of its own.
BUDGET = 65_536


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding (sum over rows of bound - length).

    Exact: one pass per bucket over the distinct lengths. Closing a bucket at length x costs x * rows - tokens, so the
    best opening is the lowest of lines over x, of which only a lower hull must be kept.
    """
    order = np.argsort(lengths)
    x, c = [int(v) for v in np.asarray(lengths)[order]], [int(v) for v in np.asarray(counts)[order]]
    n = len(x)
    if n == 0:
        return []
    rows, tokens = [0], [0]
    for length, count in zip(x, c):
        rows.append(rows[-1] + count)
        tokens.append(tokens[-1] + length * count)
    cost = [0] + [x[j - 1] * rows[j] - tokens[j] for j in range(1, n + 1)]  # one bucket
    opened = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # (slope, height, opening), slopes falling
        new, where, lowest = list(cost), [0] * (n + 1), 0
        for j in range(1, n + 1):
            line = (-rows[j - 1], cost[j - 1] + tokens[j - 1], j - 1)
            while len(hull) - lowest >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            at = x[j - 1]
            while len(hull) - lowest >= 2 and hull[lowest + 1][0] * at + hull[lowest + 1][1] <= hull[lowest][0] * at + hull[lowest][1]:
                lowest += 1
            slope, height, opening = hull[lowest]
            new[j], where[j] = slope * at + height + at * rows[j] - tokens[j], opening
        cost = new
        opened.append(where)
    bounds, j, k = [], n, len(opened) - 1
    while j > 0:
        bounds.append(x[j - 1])
        j, k = (opened[k][j] if k > 0 else 0), k - 1
    return bounds[::-1]


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """One row per document: length, bucket, the bucket's bound (the padded length), batch and place in the batch.

    A length is the number of words [^\\x20\\x09-\\x0D]+ and an end mark, or the column `length`. Null and empty texts have
    the end mark alone and null lengths count as 0; null ids come first; repeated rows are packed each; an empty table
    gives no rows. Only the histogram (one row per distinct length) reaches the driver. Batches take documents of one
    bucket in the order of a hash of their ids, as many as fit the budget when padded. Texts are read once, never shuffled.
    """
    tokens = F.coalesce(F.col(length).cast("long"), F.lit(0)) if length else F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
    sized = cut_lineage(documents.select(F.col(key).cast("long").alias("doc_id"), tokens.alias("n_tokens")))
    histogram = sized.groupBy("n_tokens").count().collect()
    bounds = best_bounds(np.array([r["n_tokens"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets)
    edges = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("bound", F.try_element_at(edges, F.col("bucket") + 1)).withColumn("_order", F.xxhash64("doc_id"))
    numbered = number_within(placed, ["bucket"], ["_order", "doc_id", "n_tokens"], "_row")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))).cast("long"))
    return numbered.select("doc_id", "n_tokens", "bucket", "bound", F.floor(F.col("_row") / fit).cast("long").alias("batch"), F.pmod("_row", fit).alias("slot"))


def op7_length_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_length_packing": op7_length_packing}
ORACLE: dict[str, str] = {}
