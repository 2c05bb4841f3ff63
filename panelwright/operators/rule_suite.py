"""Many row-level rules of one table in one scan.

Every rule is a condition that no row may meet. All are counted in one aggregate; rules that list their violations by key
are looked at again, all at once and only if they failed, over the rows that break one of them. Results have the form of
the single operators: (check, key, observed, expected).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import finite
from panelwright.operators.checks import _key


@dataclass(frozen=True)
class Rule:
    """`broken` tells the rows that break it. `keys` lists the violations by these columns, with counts; else one row named `key`."""

    check: str
    key: str
    broken: Column
    keys: tuple[str, ...] = ()


def finite_rules(cols: Sequence[str]) -> list[Rule]:
    return [Rule("finite", c, ~finite(c)) for c in cols]


def integer_rules(keys: Sequence[str], month: str | None = None) -> list[Rule]:
    out = [Rule("integer_keys", c, F.col(c).isNull() | (F.col(c) != F.floor(c))) for c in keys]
    if month:
        out.append(Rule("integer_keys", month, F.col(month).isNull() | (F.col(month) != F.floor(month)) | ~F.col(month).between(1, 12)))
    return out


def domain_rule(column: str, allowed: Sequence) -> Rule:
    return Rule("domain", column, F.col(column).isNull() | ~F.col(column).isin(list(allowed)), (column,))


def range_rule(column: str, low: float, high: float, keys: Sequence[str] = ()) -> Rule:
    """Finite values outside the closed range."""
    return Rule("range", column, finite(column) & ~F.col(column).between(low, high), tuple(keys))


def definition_rule(column: str, definition: Column, tol: float = 1e-10, keys: Sequence[str] = ()) -> Rule:
    """Stored values that differ from their definition."""
    return Rule("definition", column, ~_same(definition, F.col(column), tol), tuple(keys))


def _same(a: Column, b: Column, tol: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())


def flag_rule(name: str, explicit: Column, flag: Column, keys: Sequence[str] = ()) -> Rule:
    """Rows on which a rule and a stored flag disagree; null counts as false."""
    return Rule("flag", name, F.coalesce(explicit, F.lit(False)) != F.coalesce(flag, F.lit(False)), tuple(keys))


def rule_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(check, key, rows, broken, status) of every rule from one scan."""
    counts = [F.count(F.when(r.broken, 1)).alias(f"_r{i}") for i, r in enumerate(rules)]
    cells = [F.struct(F.lit(r.check).alias("check"), F.lit(r.key).alias("key"), F.col("rows"), F.col(f"_r{i}").alias("broken")) for i, r in enumerate(rules)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    return one.select(F.inline(F.array(*cells))).withColumn("status", F.when(F.col("broken") == 0, "PASS").otherwise("FAIL"))


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations of all rules: one scan for the counts, and one more only if rules with keys failed.

    The counts, one number a rule, come to the driver to decide that.
    """
    if len({(r.check, r.key) for r in rules}) < len(rules):
        raise ValueError("rules need names of their own")
    found = {(r["check"], r["key"]): r["broken"] for r in rule_report(df, rules).collect()}
    plain = [(r.check, r.key, float(found[r.check, r.key]), 0.0) for r in rules if found[r.check, r.key] and not r.keys]
    out = df.sparkSession.createDataFrame(plain, "check string, key string, observed double, expected double")
    failed = [r for r in rules if found[r.check, r.key] and r.keys]
    if not failed:
        return out
    cells = [F.when(r.broken, F.struct(F.lit(i).alias("rule"), F.lit(r.check).alias("check"), _key(r.keys).alias("key"))) for i, r in enumerate(failed)]
    listed = df.select(F.array_compact(F.array(*cells)).alias("_c")).where(F.size("_c") > 0).select(F.inline("_c"))
    listed = listed.groupBy("rule", "check", "key").agg(F.count(F.lit(1)).cast("double").alias("observed"))
    return out.unionByName(listed.select("check", "key", "observed", F.lit(0.0).alias("expected")))
