"""From dated records to entity-month tables, and the site sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Band name -> (reduction, scale, offset).
BANDS = {
    "NPP": ("sum", 0.0001, 0.0),
    "LST_Day_1km": ("mean", 0.02, -273.15),
    "NDVI": ("mean", 0.0001, 0.0),
    "temperature_2m": ("mean", 1.0, -273.15),
    "dewpoint_temperature_2m": ("mean", 1.0, -273.15),
    "Precipitation_mm": ("mean", 1000.0, 0.0),
    "volumetric_soil_water_layer_1": ("mean", 1.0, 0.0),
    "surface_solar_radiation_downwards_sum": ("mean", 0.000001, 0.0),
}
SNOW_BIT = 16384
CLASS_SIZES = {61: 15, 246: 15, 499: 15, 504: 29, 556: 32, 497: 141}


def composites_to_monthly(
    df: DataFrame, keys: Sequence[str], date: str, band: str, value: str, spec: Mapping[str, tuple[str, float, float]],
    missing: float | None = None,
) -> DataFrame:
    """Long (keys, date, band, value) records to one row per entity-month, one column per band."""
    aggs = []
    for name, (how, scale, offset) in spec.items():
        raw = F.when(F.col(band) == name, F.col(value))
        out = (F.sum(raw) if how == "sum" else F.avg(raw)) * F.lit(scale) + F.lit(offset)
        aggs.append((out if missing is None else F.coalesce(out, F.lit(float(missing)))).alias(name))
    return df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(*aggs)


def monthly_flag_any(df: DataFrame, keys: Sequence[str], date: str, qa: str, mask: int = SNOW_BIT) -> DataFrame:
    """Whether any record of the month has a bit of `mask` set, and the number of records."""
    hit = (F.col(qa).bitwiseAND(F.lit(mask)) != 0).cast("int")
    return df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.max(hit).alias("any_flag"), F.count(F.lit(1)).alias("record_count")
    )


def hash_order(seed: int, *keys: str) -> Column:
    """A portable pseudo-random order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_fixed_sample(df: DataFrame, stratum: str, sizes: Mapping[object, int], keys: Sequence[str], seed: int) -> DataFrame:
    """A fixed count per class in hash order, with a dense id over the sample.

    The literal bound on the row number lets Spark keep only the first few rows of each class per
    task before the exchange, so no class is gathered whole.
    """
    largest = max(sizes.values())
    limit = F.lit(0)
    for k, n in sizes.items():
        limit = F.when(F.col(stratum) == k, n).otherwise(limit)
    listed = df.where(F.col(stratum).isin(list(sizes))).withColumn("_h", hash_order(seed, *keys))
    order = Window.partitionBy(stratum).orderBy("_h", *keys)
    kept = listed.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= largest).where(F.col("_rn") <= limit)
    # the sample has sum(sizes) rows, so one ordered window numbers it
    numbered = kept.withColumn("point_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(stratum, "_h", *keys)) - 1)
    return numbered.drop("_h", "_rn")
