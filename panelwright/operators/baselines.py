"""Climatologies, anomalies, ranks, eligibility, support and attrition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import finite, flag_true, rank_quartile_bin, safe_divide
from panelwright.operators.ordering import exact_quantiles, value_counts
from panelwright.session import broadcast_if_small


def climatology(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], first_year: int, last_year: int, year: str = "year",
    stats: Sequence[str] = ("mean", "median", "n"),
) -> DataFrame:
    """Historical mean / median / count per key over [first_year, last_year].

    A group holds one value per year, so the exact median is over a handful of values.
    """
    make = {
        "mean": lambda c: F.avg(c), "median": lambda c: F.percentile(c, 0.5), "n": lambda c: F.count(c),
    }
    aggs = [make[s](c).alias(f"{c}_{s}") for c in cols for s in stats]
    return df.where(F.col(year).between(first_year, last_year)).groupBy(*keys).agg(*aggs)


def anomaly(df: DataFrame, clim: DataFrame, keys: Sequence[str], cols: Sequence[str], stat: str = "mean") -> DataFrame:
    """value - baseline for every column; a missing baseline gives a null anomaly."""
    joined = df.join(clim, list(keys), "left")
    return joined.withColumns({f"{c}_anomaly_{stat}": F.col(c) - F.col(f"{c}_{stat}") for c in cols})


def midrank_vs_history(
    df: DataFrame, history: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "_rank"
) -> DataFrame:
    """(less + (ties + 1) / 2) / (n + 1) against the history of the same key.

    The history of a key holds one value per baseline year, so it travels as one short array per
    key and the comparison is a projection.
    """
    arrays = history.groupBy(*keys).agg(*[F.collect_list(c).alias(f"_h_{c}") for c in cols])
    joined = df.join(arrays, list(keys), "left")

    def rank(c: str) -> Column:
        h, x = F.col(f"_h_{c}"), F.col(c)
        less, ties = F.size(F.filter(h, lambda v: v < x)), F.size(F.filter(h, lambda v: v == x))
        return F.when(x.isNotNull() & (F.size(h) > 0), (less + (ties + 1) * 0.5) / (F.size(h) + 1))

    return joined.withColumns({f"{c}{suffix}": rank(c) for c in cols}).drop(*[f"_h_{c}" for c in cols])


def historically_active(median: str) -> Column:
    """Median of the history above zero; no history means inactive."""
    return F.coalesce(F.col(median) > 0, F.lit(False))


def climatology_predict(
    df: DataFrame, train: DataFrame, keys: Sequence[str], target: str, out: str = "y_pred", calendar: bool = False
) -> DataFrame:
    """Training mean per key as the prediction; by month or by (entity, month).

    `calendar` says that the keys are calendar fields alone: then the means are at most a year's rows and are broadcast,
    so the fact table is not dealt out on a dozen keys.
    """
    means = train.groupBy(*keys).agg(F.avg(target).alias(out))
    return df.join(F.broadcast(means) if calendar else means, list(keys), "left")


def complete_case(cols: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & finite(c)
    return ok


def eligibility_flags(
    df: DataFrame, fields: Sequence[str], active: str, month: str = "month", season: tuple[int, int] = (4, 9),
    good_fraction: str | None = None, dayweighted: tuple[str, str] | None = None, cold: tuple[str, str, str] | None = None,
) -> DataFrame:
    """0/1 eligibility columns; one projection.

    `dayweighted` = (active flag, anomaly column); `cold` = (temperature, snow flag, snow known).
    """
    complete = complete_case(fields)
    primary = flag_true(active) & complete
    in_season = F.col(month).between(*season)
    flags = {
        "eligible_primary": primary, "eligible_all12": complete, "domain_season": in_season,
        "eligible_season": complete & in_season, "eligible_median_response": primary, "eligible_raw_exposure": primary,
    }
    if good_fraction:
        flags["eligible_qa1"] = primary & F.coalesce(F.col(good_fraction) >= 0.75, F.lit(False))
        flags["eligible_qa2"] = primary & F.coalesce(F.col(good_fraction) >= 1.0, F.lit(False))
    if dayweighted:
        flags["eligible_dayweighted"] = flag_true(dayweighted[0]) & finite(dayweighted[1]) & complete
    if cold:
        temperature, snow, known = cold
        warm = finite(temperature) & (F.col(temperature) > 0)
        flags["eligible_cold_snow"] = primary & F.coalesce(warm, F.lit(False)) & flag_true(known) & F.coalesce(F.col(snow) == 0, F.lit(False))
    return df.withColumns({k: v.cast("int") for k, v in flags.items()})


def monthly_qa(df: DataFrame, keys: Sequence[str], usable: str) -> DataFrame:
    """Share of usable composites and composite count per key, with the two QA levels."""
    return (
        df.groupBy(*keys).agg(F.avg(usable).alias("good_fraction"), F.count(F.lit(1)).alias("composite_count"))
        .withColumn("qa1", F.coalesce(F.col("good_fraction") >= 0.75, F.lit(False)).cast("int"))
        .withColumn("qa2", F.coalesce(F.col("good_fraction") >= 1.0, F.lit(False)).cast("int"))
    )


def snow_state(df: DataFrame, flag: str, count: str) -> DataFrame:
    """Known only for a 0/1 flag backed by at least one composite; the flag is null when unknown."""
    known = F.coalesce(F.col(flag).isin(0, 1) & (F.col(count) > 0), F.lit(False))
    return df.withColumn("snow_known", known.cast("int")).withColumn("snow", F.when(known, F.col(flag)).cast("int"))


def dayweighted_target(
    monthly: DataFrame, keys: Sequence[str], value: str, history: tuple[int, int], evaluation: tuple[int, int],
    year: str = "year", month: str = "month",
) -> DataFrame:
    """Baseline, anomaly and active flag of a day-weighted monthly target in the evaluation years."""
    clim = climatology(monthly, [*keys, month], [value], *history, year=year, stats=("mean", "median"))
    ev = monthly.where(F.col(year).between(*evaluation))
    return anomaly(ev, clim, [*keys, month], [value]).withColumn("dayweighted_active", historically_active(f"{value}_median").cast("int"))


# --- pooled anomalies -----------------------------------------------------------------------

def pooled_anomaly_pool(
    df: DataFrame, clim: DataFrame, keys: Sequence[str], cols: Sequence[str], active_median: str, first_year: int, last_year: int,
    year: str = "year",
) -> DataFrame:
    """Finite historical anomalies of the active keys."""
    hist = df.where(F.col(year).between(first_year, last_year))
    with_anomaly = anomaly(hist, clim, keys, cols).where(historically_active(active_median))
    return with_anomaly.where(complete_case([f"{c}_anomaly_mean" for c in cols]))


def quantile_type1(pool: DataFrame, probs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Inverse-ECDF quantiles as (name, column, probability, value) rows."""
    out = None
    for column in sorted({c for c, _ in probs.values()}):
        mine = {k: p for k, (c, p) in probs.items() if c == column}
        wide = exact_quantiles(pool, column, mine, inverse_cdf=True)
        cells = [F.struct(F.lit(k).alias("name"), F.lit(column).alias("field"), F.lit(p).alias("probability"), F.col(k).alias("value")) for k, p in mine.items()]
        rows = wide.select(F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out


def empirical_rank(df: DataFrame, value: str, pool: DataFrame, pool_value: str, out: str) -> DataFrame:
    """(less + ties/2 + 1/2) / (n + 1) against one global pool.

    Both sides reduce to distinct values before the ordering; the rank returns by an equi-join.
    """
    xs = df.select(F.col(value).alias("_x"), F.lit(0).cast("long").alias("_w"))
    both = xs.unionByName(pool.select(F.col(pool_value).alias("_x"), F.lit(1).cast("long").alias("_w")))
    ranks = value_counts(both, "_x", weight=F.col("_w"))
    n = pool.select(F.count(pool_value)).scalar()
    ranks = ranks.select(F.col("_x").alias(value), ((F.col("n_before") + F.col("n") * 0.5 + 0.5) / (n + 1)).alias(out))
    return df.join(broadcast_if_small(ranks), value, "left")


# --- support --------------------------------------------------------------------------------

Center = tuple[str, float, float]


def _near(x: str, y: str, cx: Column, cy: Column, radius: float) -> Column:
    squared = (F.col(x) - cx) * (F.col(x) - cx) + (F.col(y) - cy) * (F.col(y) - cy)
    return F.coalesce(F.sqrt(squared) <= radius, F.lit(False))


def at_centers(df: DataFrame, x: str, y: str, centers: Sequence[Center], radius: float) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("point"), F.lit(float(a)).alias("x_target"), F.lit(float(b)).alias("y_target")) for n, a, b in centers]
    spread = df.withColumn("_c", F.explode(F.array(*cells))).select("*", "_c.*").drop("_c")
    return spread.withColumn("_near", _near(x, y, F.col("x_target"), F.col("y_target"), radius))


def _support_aggs(entity: str, year: str, keep: Column, names=("n_records", "n_sites", "n_years")) -> list[Column]:
    return [
        F.count(F.when(keep, 1)).alias(names[0]), F.count_distinct(F.when(keep, F.col(entity))).alias(names[1]),
        F.count_distinct(F.when(keep, F.col(year))).alias(names[2]),
    ]


def support_counts(
    df: DataFrame, x: str, y: str, centers: Sequence[Center], entity: str, year: str = "year", radius: float = 0.10,
    minimum: tuple[int, int, int] = (100, 50, 3), by: Sequence[str] = (),
) -> DataFrame:
    """Records, entities and years near each point, with PASS/FAIL. Points without support stay, with zeros."""
    out = at_centers(df, x, y, centers, radius).groupBy(*by, "point", "x_target", "y_target").agg(*_support_aggs(entity, year, F.col("_near")))
    ok = (F.col("n_records") >= minimum[0]) & (F.col("n_sites") >= minimum[1]) & (F.col("n_years") >= minimum[2])
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def support_by_class(
    df: DataFrame, x: str, y: str, centers: Sequence[Center], group: str, entity: str, year: str = "year",
    radius: float = 0.10, minimum: tuple[int, int, int] = (50, 25, 3),
) -> DataFrame:
    """One row per class; it qualifies only when every point passes."""
    aggs, ok = [], F.lit(True)
    for name, a, b in centers:
        names = (f"{name}_records", f"{name}_sites", f"{name}_years")
        aggs += _support_aggs(entity, year, _near(x, y, F.lit(float(a)), F.lit(float(b)), radius), names)
        for n, m in zip(names, minimum):
            ok = ok & (F.col(n) >= m)
    return df.groupBy(group).agg(*aggs).withColumn("status", F.when(ok, "QUALIFIED").otherwise("NOT_ESTIMABLE"))


def support_attrition(
    df: DataFrame, x: str, y: str, centers: Sequence[Center], domains: Mapping[str, Column], reference: str, entity: str,
    year: str = "year", radius: float = 0.10,
) -> DataFrame:
    """Support near each point per domain and the share of the reference domain's records kept."""
    cells = [F.struct(F.lit(d).alias("domain"), F.coalesce(c, F.lit(False)).alias("_in")) for d, c in domains.items()]
    spread = at_centers(df.withColumn("_d", F.array(*cells)), x, y, centers, radius).select("*", F.inline("_d")).drop("_d")
    keep = F.col("_near") & F.col("_in")
    counts = spread.groupBy("point", "domain").agg(*_support_aggs(entity, year, keep, ("records", "sites", "years")))
    base = counts.where(F.col("domain") == reference).select("point", F.col("records").alias("_base"))
    return counts.join(base, "point").withColumn("retention", safe_divide("records", "_base")).drop("_base")


# --- attrition and composition --------------------------------------------------------------

def attrition_by_stratum(
    df: DataFrame, flags: Mapping[str, Column], ranks: Mapping[str, str], plain: Sequence[str]
) -> DataFrame:
    """n, kept and fraction per flag for rank quartiles and for plain columns, stacked."""
    strata = [F.struct(F.lit(n).alias("stratum_type"), rank_quartile_bin(c).alias("stratum_value")) for n, c in ranks.items()]
    strata += [F.struct(F.lit(c).alias("stratum_type"), F.col(c).cast("string").alias("stratum_value")) for c in plain]
    long = df.select(*[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in flags.items()], F.inline(F.array(*strata)))
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in flags:
        aggs += [F.sum(k).alias(f"n_{k}"), F.avg(k).alias(f"{k}_fraction")]
    return long.where(F.col("stratum_value").isNotNull()).groupBy("stratum_type", "stratum_value").agg(*aggs)


def attrition_by_reason(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Mutually exclusive reason per row, 'multiple' when several hold; every level appears."""
    hits = {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in reasons.items()}
    total = F.lit(0)
    for h in hits.values():
        total = total + h
    label = F.when(total > 1, "multiple")
    for k, h in hits.items():
        label = label.when(h == 1, k)
    levels = ["retained", *reasons, "multiple"]
    one = df.select(label.otherwise("retained").alias("_r")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col("_r") == v, 1)).alias(v) for v in levels]
    )
    cells = [F.struct(F.lit(v).alias("reason"), F.col(v).alias("n_records"), safe_divide(F.col(v), F.col("_n")).alias("fraction")) for v in levels]
    return one.select(F.inline(F.array(*cells)))


def domain_composition(
    df: DataFrame, selectors: Mapping[str, Column], reference: str, active: Column, entity: str, year: str = "year", month: str = "month"
) -> DataFrame:
    """Per domain: records, entities, years, months, active share, overlap with the reference domain."""
    ref = F.coalesce(selectors[reference], F.lit(False))
    cells = [F.struct(F.lit(k).alias("domain"), F.coalesce(c, F.lit(False)).alias("_in")) for k, c in selectors.items()]
    base = df.select(
        F.col(entity).alias("_e"), F.col(year).alias("_y"), F.col(month).alias("_m"), F.coalesce(active, F.lit(False)).alias("_a"),
        ref.alias("_ref"), F.array(*cells).alias("_d"),
    )
    i, r = F.col("_in"), F.col("_ref")
    return base.select("*", F.inline("_d")).groupBy("domain").agg(
        F.count(F.when(i, 1)).alias("n_records"), F.count_distinct(F.when(i, F.col("_e"))).alias("n_sites"),
        F.count_distinct(F.when(i, F.col("_y"))).alias("n_years"), F.count_distinct(F.when(i, F.col("_m"))).alias("n_months"),
        F.avg(F.when(i, F.col("_a").cast("int"))).alias("active_share"),
        F.count(F.when(i & r, 1)).alias("both"), F.count(F.when(i & ~r, 1)).alias("domain_only"), F.count(F.when(~i & r, 1)).alias("reference_only"),
    )


def sample_summary(df: DataFrame, selectors: Mapping[str, Column], reference: str, entity: str, year: str = "year") -> DataFrame:
    """Per domain: n, entities, years, share of the reference domain's records."""
    full = domain_composition(df, selectors, reference, F.lit(True), entity, year)
    n_ref = F.col("both") + F.col("reference_only")
    return full.select("domain", "n_records", "n_sites", "n_years", safe_divide(F.col("n_records"), n_ref).alias("retention"))


def excluded_by_year(df: DataFrame, excluded: Column, entity: str, year: str = "year") -> DataFrame:
    """Rows removed and kept, and entities kept, per year."""
    e = F.coalesce(excluded, F.lit(False))
    return df.groupBy(year).agg(
        F.count(F.when(e, 1)).alias("n_excluded"), F.count(F.when(~e, 1)).alias("n_kept"),
        F.count_distinct(F.when(~e, F.col(entity))).alias("sites_kept"),
    )
