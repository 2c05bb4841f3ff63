"""Expectations. Each returns the violations as rows; an empty result means the check holds.

Columns: check (string), key (string), observed (double), expected (double).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import finite, null_safe_equal


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])


def _violation(df: DataFrame, check: str, key: Column, observed: Column, expected: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), key.alias("key"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected")
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metadata only: raises when a column is absent, else returns the frame unchanged."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return _violation(dup, "unique", _key(keys), F.col("_n"), F.lit(1))


def expect_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with missing or non-finite values; a single aggregate."""
    counts = df.agg(*[F.count(F.when(~finite(c), 1)).alias(c) for c in cols])
    return _unpivot(counts, cols, "finite").where(F.col("observed") > 0)


def _unpivot(one_row: DataFrame, cols: Sequence[str], check: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("observed")) for c in cols]
    return one_row.select(F.inline(F.array(*cells))).select(
        F.lit(check).alias("check"), "key", "observed", F.lit(0.0).alias("expected")
    )


def expect_integer_keys(df: DataFrame, keys: Sequence[str], month: str = "month") -> DataFrame:
    """Key columns hold integers and the month lies in 1..12."""
    bad = {c: F.col(c).isNull() | (F.col(c) != F.floor(c)) for c in keys}
    bad[month] = F.col(month).isNull() | (F.col(month) != F.floor(month)) | ~F.col(month).between(1, 12)
    counts = df.agg(*[F.count(F.when(b, 1)).alias(c) for c, b in bad.items()])
    return _unpivot(counts, list(bad), "integer_keys").where(F.col("observed") > 0)


def expect_complete_history(df: DataFrame, keys: Sequence[str], time: str, n: int) -> DataFrame:
    """Entities that do not have exactly n contiguous periods."""
    per = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct(time).alias("_d"), (F.max(time) - F.min(time) + 1).alias("_span")
    )
    bad = per.where((F.col("_rows") != n) | (F.col("_d") != n) | (F.col("_span") != n))
    return _violation(bad, "complete_history", _key(keys), F.col("_d"), F.lit(n))


def expect_domain(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values outside the allowed list, with their row counts."""
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(list(allowed))).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return _violation(bad, "domain", _key([column]), F.col("_n"), F.lit(0))


def expect_counts(df: DataFrame, by: str, entity: str, expected: DataFrame) -> DataFrame:
    """Rows and distinct entities per group against an expectation table (by, n_rows, n_entities)."""
    seen = df.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(entity).alias("_ents"))
    both = seen.join(expected, by, "full_outer")
    rows = F.struct(F.lit("rows").alias("what"), F.coalesce("_rows", F.lit(0)).alias("o"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("e"))
    ents = F.struct(
        F.lit("entities").alias("what"), F.coalesce("_ents", F.lit(0)).alias("o"), F.coalesce("n_entities", F.lit(0)).cast("long").alias("e")
    )
    long = both.select(by, F.inline(F.array(rows, ents))).where(F.col("o") != F.col("e"))
    return _violation(long, "counts", F.concat_ws("|", F.col(by).cast("string"), "what"), F.col("o"), F.col("e"))


def expect_same_keys(df: DataFrame, group: str, levels: Sequence, cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every group must hold exactly the cohort's keys.

    One aggregate per key collects the groups present (bounded by `levels`), so neither a product
    of groups and keys nor a join per group is needed.
    """
    mine = df.select(*keys, F.col(group).alias("_g"), F.lit(0).alias("_c"))
    want = cohort.select(*keys, F.lit(None).cast(df.schema[group].dataType).alias("_g"), F.lit(1).alias("_c"))
    per = mine.unionByName(want).groupBy(*keys).agg(F.collect_set("_g").alias("_have"), F.max("_c").alias("_in"))
    full = F.array(*[F.lit(v).cast(df.schema[group].dataType) for v in levels])
    missing = F.when(F.col("_in") == 1, F.array_except(full, "_have")).otherwise(F.array().cast(f"array<{df.schema[group].dataType.simpleString()}>"))
    extra = F.when(F.col("_in") == 0, F.col("_have")).otherwise(F.array().cast(f"array<{df.schema[group].dataType.simpleString()}>"))
    rows = per.select(*keys, F.explode(missing).alias("_g"), F.lit(0.0).alias("o"), F.lit(1.0).alias("e")).unionByName(
        per.select(*keys, F.explode(extra).alias("_g"), F.lit(1.0).alias("o"), F.lit(0.0).alias("e"))
    )
    return _violation(rows, "same_keys", _key(["_g", *keys]), F.col("o"), F.col("e"))


def expect_equal_across(df: DataFrame, keys: Sequence[str], value: str, tol: float = 0.0) -> DataFrame:
    """Keys whose value differs between groups by more than `tol`."""
    per = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_d")).where(F.col("_d") > tol)
    return _violation(per, "equal_across", _key(keys), F.col("_d"), F.lit(tol))


def expect_constant_within(df: DataFrame, key: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Attributes that take more than one value within a key."""
    cells = [F.struct(F.lit(a).alias("attr"), F.count_distinct(a).alias("n")) for a in attrs]
    per = df.groupBy(*key).agg(F.array(*cells).alias("_c")).select(*key, F.inline("_c")).where(F.col("n") > 1)
    return _violation(per, "constant_within", _key([*key, "attr"]), F.col("n"), F.lit(1))


def expect_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float = 1e-12) -> DataFrame:
    """Keys on one side only, or shared keys whose values differ by more than `tol`."""
    a = left.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_ina"))
    b = right.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_inb"))
    both = a.join(b, list(keys), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & null_safe_equal(F.col(f"_a_{v}"), F.col(f"_b_{v}"), tol)
    status = F.when(F.col("_ina").isNull(), 1).when(F.col("_inb").isNull(), 2).when(~same, 3).otherwise(0)
    bad = both.withColumn("_s", status).where(F.col("_s") > 0)
    return _violation(bad, "coverage", _key(keys), F.col("_s"), F.lit(0))


def expect_disjoint(df: DataFrame, role: str, held_out: str, entity: Sequence[str]) -> DataFrame:
    """Entities that occur both in the held-out role and in another role."""
    per = df.groupBy(*entity).agg(
        F.count(F.when(F.col(role) == held_out, 1)).alias("_in"), F.count(F.when(F.col(role) != held_out, 1)).alias("_out")
    )
    bad = per.where((F.col("_in") > 0) & (F.col("_out") > 0))
    return _violation(bad, "disjoint", _key(entity), F.col("_out"), F.lit(0))


def expect_join_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str = "one_to_one") -> DataFrame:
    """Duplicate join keys on the sides that must be unique."""
    sides = {"one_to_one": "lr", "many_to_one": "r", "one_to_many": "l"}[kind]
    out = None
    for name, side in (("left", left), ("right", right)):
        if name[0] in sides:
            v = expect_unique(side, keys).withColumn("check", F.lit(f"{kind}:{name}"))
            out = v if out is None else out.unionByName(v)
    return out


def expect_grid(df: DataFrame, first: str, first_levels: Sequence, second: str, second_levels: Sequence) -> DataFrame:
    """Missing, repeated or unexpected (first, second) pairs of a complete grid of literals."""
    wanted = {(a, b) for a in first_levels for b in second_levels}
    t1, t2 = df.schema[first].dataType, df.schema[second].dataType
    cells = [F.struct(F.lit(a).cast(t1).alias(first), F.lit(b).cast(t2).alias(second)) for a, b in sorted(wanted)]
    # an aggregate without keys always yields one row, so the grid appears even for an empty table
    grid = df.agg(F.count(F.lit(1)).alias("_n")).select(F.inline(F.array(*cells))).withColumn("_want", F.lit(1))
    seen = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("_n"))
    both = grid.join(seen, [first, second], "full_outer").select(
        first, second, F.coalesce("_n", F.lit(0)).alias("o"), F.coalesce("_want", F.lit(0)).alias("e")
    )
    return _violation(both.where(F.col("o") != F.col("e")), "grid", _key([first, second]), F.col("o"), F.col("e"))


def flag_identity(df: DataFrame, explicit: Column, flag: Column) -> DataFrame:
    """One row: how an explicit rule and a stored flag agree."""
    e, f = F.coalesce(explicit, F.lit(False)), F.coalesce(flag, F.lit(False))
    out = df.select(e.alias("_e"), f.alias("_f")).agg(
        F.count(F.when(F.col("_e"), 1)).alias("explicit_n"),
        F.count(F.when(F.col("_f"), 1)).alias("flagged_n"),
        F.count(F.when(F.col("_e") & F.col("_f"), 1)).alias("both_n"),
        F.count(F.when(F.col("_e") & ~F.col("_f"), 1)).alias("missing_n"),
        F.count(F.when(~F.col("_e") & F.col("_f"), 1)).alias("extra_n"),
    )
    return out.withColumn("status", F.when((F.col("missing_n") == 0) & (F.col("extra_n") == 0), "PASS").otherwise("FAIL"))


def flag_mismatches(df: DataFrame, explicit: Column, flag: Column, keys: Sequence[str]) -> DataFrame:
    """The rows on which rule and flag disagree."""
    e, f = F.coalesce(explicit, F.lit(False)), F.coalesce(flag, F.lit(False))
    return df.where(e != f).select(*keys, e.alias("explicit"), f.alias("flagged"))


def reconstruct_check(df: DataFrame, definition: Column, column: str, tol: float = 1e-10) -> DataFrame:
    """One row: how well a stored column equals its definition."""
    d = df.select(definition.alias("_d"), F.col(column).alias("_s"))
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(F.col("_d") - F.col("_s"))).alias("max_abs_difference"),
        F.count(F.when(~null_safe_equal("_d", "_s", tol), 1)).alias("mismatches"),
    ).withColumn("status", F.when(F.col("mismatches") == 0, "PASS").otherwise("FAIL"))


def expect_centered(df: DataFrame, group: Sequence[str], column: str, tol: float = 1e-10) -> DataFrame:
    """Groups whose mean is further than `tol` from zero."""
    per = df.groupBy(*group).agg(F.avg(column).alias("_m")).where(F.abs(F.col("_m")) > tol)
    return _violation(per, "centered", _key(group), F.col("_m"), F.lit(0))


def semantic_range_check(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: minimum, maximum, non-finite count and PASS/FAIL against open bounds."""
    cells = [
        F.struct(
            F.lit(c).alias("field"), F.min(F.when(finite(c), F.col(c).cast("double"))).alias("minimum"),
            F.max(F.when(finite(c), F.col(c).cast("double"))).alias("maximum"),
            F.count(F.when(~finite(c), 1)).alias("nonfinite"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"),
        )
        for c, (lo, hi) in ranges.items()
    ]
    good = (F.col("nonfinite") == 0) & (F.col("minimum") > F.col("_lo")) & (F.col("maximum") < F.col("_hi"))
    return (
        df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
        .withColumn("status", F.when(good, "PASS").otherwise("FAIL")).drop("_lo", "_hi")
    )


def sample_id_check(manifest: DataFrame, index: DataFrame, sample_id: str, keys: Sequence[str]) -> DataFrame:
    """Manifest ids that do not map back to the same key in the index."""
    ref = index.select(sample_id, *[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    bad = manifest.join(ref, sample_id, "left").where(~same)
    return _violation(bad, "sample_id", _key([sample_id, *keys]), F.lit(1), F.lit(0))


def field_completeness(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing and non-finite counts per field, long, with PASS/FAIL."""
    cells = [
        F.struct(
            F.lit(c).alias("field"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"),
            F.count(F.when(F.col(c).isNotNull() & ~finite(c), 1)).alias("nonfinite"),
        )
        for c in cols
    ]
    grouped = df.groupBy(*by).agg(F.array(*cells).alias("_c")).select(*by, F.inline("_c"))
    return grouped.withColumn("status", F.when((F.col("missing") == 0) & (F.col("nonfinite") == 0), "PASS").otherwise("FAIL"))


def key_identity(a: DataFrame, b: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Two key sets in one row: sizes, entities, duplicates, keys missing from or extra in `b`."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per = tagged.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    out = per.agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"),
        F.count_distinct(F.when(F.col("_a") > 0, F.col(entity))).alias("entities_a"),
        F.count_distinct(F.when(F.col("_b") > 0, F.col(entity))).alias("entities_b"),
        F.sum(F.greatest(F.col("_a") - 1, F.lit(0))).alias("duplicates_a"),
        F.sum(F.greatest(F.col("_b") - 1, F.lit(0))).alias("duplicates_b"),
        F.count(F.when((F.col("_a") > 0) & (F.col("_b") == 0), 1)).alias("missing"),
        F.count(F.when((F.col("_a") == 0) & (F.col("_b") > 0), 1)).alias("extra"),
    )
    clean = F.lit(True)
    for c in ("duplicates_a", "duplicates_b", "missing", "extra"):
        clean = clean & (F.col(c) == 0)
    return out.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))
