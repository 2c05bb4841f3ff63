"""Sinks and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """Parquet; an existing output is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One directory per value; rows of one value are spread over several files, so a hot value does not
    become one task."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", 5_000_000).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def mean_sd_text(mean: str, sd: str, digits: int = 3) -> Column:
    """'mean ± sd', the mean alone without a spread, an empty text without a mean."""
    f = f"%.{digits}f"
    return (
        F.when(F.col(mean).isNull(), "").when(F.col(sd).isNull(), F.format_string(f, F.col(mean)))
        .otherwise(F.format_string(f"{f} ± {f}", F.col(mean), F.col(sd)))
    )


def interval_text(value: str, lower: str, upper: str, digits: int = 3) -> Column:
    """'delta [lo, hi]'."""
    f = f"%.{digits}f"
    known = F.col(value).isNotNull() & F.col(lower).isNotNull() & F.col(upper).isNotNull()
    return F.when(known, F.format_string(f"{f} [{f}, {f}]", F.col(value), F.col(lower), F.col(upper))).otherwise("")


def formatted_report(df: DataFrame, model: str, metrics: Sequence[str], order: Sequence[str], digits: int = 3) -> DataFrame:
    """One text column per metric, with the model's place in the catalogue; unknown models come last."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model))
    position = F.when(place > 0, place).otherwise(len(order) + 1).cast("int")
    texts = [mean_sd_text(f"{m}_mean", f"{m}_sd", digits).alias(m) for m in metrics]
    return df.select(position.alias("position"), model, *texts)
