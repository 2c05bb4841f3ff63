"""Scans and column contracts."""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import finite_or_null
from panelwright.operators.ordering import dense_index


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a declared schema (a struct or its DDL); only an empty field is missing."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(paths)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def alias_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Add `new` from `old` where only the old name exists."""
    for old, new in names.items():
        if new not in df.columns and old in df.columns:
            df = df.withColumn(new, F.col(old))
    return df


def coerce_numeric(df: DataFrame, cols: Sequence[str], strict: bool = False, to: str = "double") -> DataFrame:
    """Permissive: unreadable text becomes null. Strict: the job fails on it."""
    if strict:
        return df.withColumns({c: F.col(c).cast(to) for c in cols})
    return df.withColumns({c: F.col(c).try_cast(to) for c in cols})


def sentinel_to_null(df: DataFrame, cols: Sequence[str], value: float = -9999) -> DataFrame:
    """Sentinel, NaN and infinities become null."""
    return df.withColumns({c: F.when(F.col(c) != value, finite_or_null(c)) for c in cols})


def invalid_input(column: str, value: float = -9999) -> Column:
    """True where a measure is missing, non-finite or the sentinel. Take it before `sentinel_to_null`
    and any fill: a flag column then replaces a poisoned value."""
    return finite_or_null(column).isNull() | F.coalesce(F.col(column) == value, F.lit(False))


def keep_invalid_flag(df: DataFrame, column: str, out: str = "is_invalid_input") -> DataFrame:
    return df.withColumn(out, invalid_input(column))


def union_manifests(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def manifest_order_violations(df: DataFrame, draw: str = "draw_id", order: str = "row_order") -> DataFrame:
    """Draws whose row order is not dense from zero. Aggregates only; no window over a draw."""
    per = df.groupBy(draw).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(order).alias("distinct_orders"), F.min(order).alias("first"), F.max(order).alias("last")
    )
    return per.where((F.col("n") != F.col("distinct_orders")) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1))


def manifest_differences(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of the union of parts that the consolidated file lacks, and the reverse, with multiplicities."""
    cols = parts.columns
    tagged = parts.withColumn("_w", F.lit(1)).unionByName(whole.select(*cols).withColumn("_w", F.lit(-1)))
    return tagged.groupBy(*cols).agg(F.sum("_w").alias("surplus")).where(F.col("surplus") != 0)


def dense_order(df: DataFrame, draw: str, by: Sequence[str], out: str = "row_order") -> DataFrame:
    """0-based dense order within each draw, without gathering a draw in one task."""
    return dense_index(df, by, out, by=[draw])


def read_tensors(spark: SparkSession, path: str, values: str, sample_ids: str = "sample_id") -> DataFrame:
    """`.npz` caches as (path, sample_id, tensor array<array<double>>); files are opened inside the tasks."""

    def open_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as data:
                    block = np.asarray(data[values], dtype=float)
                    ids = np.asarray(data[sample_ids], dtype="int64")
                yield pd.DataFrame({"path": name, "sample_id": ids, "tensor": [row.tolist() for row in block]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(open_files, "path string, sample_id long, tensor array<array<double>>")


def tensor_to_long(df: DataFrame, tensor: str, features: Sequence[str], keep: Sequence[str], out: str = "shap") -> DataFrame:
    """(steps x features) arrays to rows; the last step is lag 1."""
    steps = df.select(*keep, F.size(tensor).alias("_w"), F.posexplode(tensor).alias("_t", "_row"))
    cells = steps.select(*keep, (F.col("_w") - F.col("_t")).alias("lag"), F.posexplode("_row").alias("_f", out))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return cells.select(*keep, "lag", name.alias("feature"), out)
