"""The join shapes the analyses use. Sizes are left to adaptive execution unless they were counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.checks import expect_join_cardinality
from panelwright.session import broadcast_if_small


def _validated(left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str, validate: bool) -> None:
    if validate:
        first = expect_join_cardinality(left, right, keys, kind).take(1)
        if first:
            raise ValueError(f"{kind} violated at {first[0]['key']}")


def attach_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool = False) -> DataFrame:
    """Left join of two tables unique on the same keys."""
    _validated(left, right, keys, "one_to_one", validate)
    return left.join(right, list(keys), "left")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool = False, max_rows: int = 0) -> DataFrame:
    """Many-to-one left join. With `max_rows`, a lookup counted to be that small is broadcast."""
    _validated(left, right, keys, "many_to_one", validate)
    return left.join(broadcast_if_small(right, max_rows) if max_rows else right, list(keys), "left")


def shared_entities(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with a column telling where each key occurs."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(keys), "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return both.withColumn("side", side).drop("_l", "_r")


def keep_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys), list(keys), "left_semi")


def drop_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys), list(keys), "left_anti")


def replicate(df: DataFrame, draws: DataFrame, entity: str) -> DataFrame:
    """Rows repeated once per draw of their entity; `draws` carries (rep, entity, copy)."""
    return df.join(draws, entity, "inner")


def align_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """What positional alignment means without positions: the right column, by key."""
    return left.join(right.select(*keys, F.col(column).alias(out)), list(keys), "left")
