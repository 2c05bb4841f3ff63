"""Standardisation over flattened training histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_weight(df: DataFrame, keys: Sequence[str], time: str, sample: Column, window: int, out: str = "weight") -> DataFrame:
    """How many training histories contain each row: training samples in the next `window` periods."""
    ahead = Window.partitionBy(*keys).orderBy(time).rangeBetween(1, window)
    return df.withColumn("_s", F.coalesce(sample, F.lit(False)).cast("int")).withColumn(out, F.coalesce(F.sum("_s").over(ahead), F.lit(0)))


def _sums(df: DataFrame, by: Sequence[str], cols: Sequence[str], weight: str, center: Mapping[str, float]) -> DataFrame:
    w = F.when(F.col(weight) > 0, F.col(weight).cast("double"))
    cells = []
    for c in cols:
        v = F.col(c) - F.lit(float(center.get(c, 0.0)))
        ok = F.when(F.col(c).isNotNull(), w)
        cells.append(
            F.struct(F.lit(c).alias("feature"), F.lit(float(center.get(c, 0.0))).alias("_c"), F.sum(ok).alias("_w"), F.sum(ok * v).alias("_wx"), F.sum(ok * v * v).alias("_wxx"))
        )
    return df.groupBy(*by).agg(F.array(*cells).alias("_a")).select(*by, F.inline("_a"))


def _moments(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    mean = F.col("_wx") / F.col("_w")
    var = F.greatest(F.col("_wxx") / F.col("_w") - mean * mean, F.lit(0.0))
    return sums.where(F.col("_w") > 0).select(*by, "feature", F.col("_w").alias("n"), (mean + F.col("_c")).alias("mean"), F.sqrt(var).alias("sd"))


def standardise_fit(
    df: DataFrame, cols: Sequence[str], weight: str, center: Mapping[str, float] | None = None
) -> DataFrame:
    """Weighted mean and population SD per feature, long. `center` is a rough mean that avoids cancellation."""
    return _moments(_sums(df, [], cols, weight, center or {}), [])


def fold_scaler(
    df: DataFrame, fold: str, folds: Sequence[int], cols: Sequence[str], weight: str, center: Mapping[str, float] | None = None
) -> DataFrame:
    """Scaler per held-out fold from the other folds: sums per own fold once, combined per held-out fold."""
    own = _sums(df, [fold], cols, weight, center or {})
    spread = own.withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in folds]))).where(F.col("held_out") != F.col(fold))
    total = spread.groupBy("held_out", "feature").agg(F.max("_c").alias("_c"), *[F.sum(c).alias(c) for c in ("_w", "_wx", "_wxx")])
    return _moments(total, ["held_out"])


def standardise_apply(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sd; the scaler is one row per feature and travels as a scalar map."""
    params = scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "sd")))).alias("m")).select("m").scalar()
    tagged = df.withColumn("_m", params)

    def scaled(c: str) -> Column:
        p = F.col("_m")[c]
        return (F.col(c) - p["mean"]) / F.when(p["sd"] > 0, p["sd"])

    return tagged.withColumns({f"{c}_scaled": scaled(c) for c in cols}).drop("_m")


def standardise_invert(value: Column, mean: Column, sd: Column, unit: float = 1000.0) -> Column:
    """Back to target units: (value * sd + mean) * unit."""
    return (value * sd + mean) * F.lit(unit)
