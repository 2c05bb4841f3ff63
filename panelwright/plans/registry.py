"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 8


def _round(c: str, digits: int) -> Column:
    """Half away from zero in primitive arithmetic, like the SQL twin's round; large values take the exact path."""
    v, unit = F.col(c), F.lit(float(10**digits))
    fast = F.signum(v) * F.floor(F.abs(v) * unit + F.lit(0.5)) / unit
    return (F.when(F.abs(v) < 1e9, fast).otherwise(F.round(v, digits)) + F.lit(0.0)).alias(c)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles so that two engines' summation orders compare equal; -0.0 becomes 0.0."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[_round(c, digits) if c in doubles else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query; `doubles` names the double columns of the SQL result to round alike."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(Tables(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            cells = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * REPLACE ({cells}) FROM ({sql})" if cells else f"SELECT * FROM ({sql})"
        return build

    return register
