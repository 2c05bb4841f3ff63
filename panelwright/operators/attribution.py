"""Roll-ups of per-sample x lag x feature attributions.

The long table (run, sample, lag, feature, value) is the large one. Every roll-up that is a mean
over samples is one partial aggregation of it; only operators that need a per-sample total shuffle
on the sample key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import direction_text, join_sorted, safe_divide, sign_tol
from panelwright.operators.ordering import average_rank, exact_quantiles
from panelwright.session import broadcast_if_small, cut_lineage

LAG_BANDS = [("recent_1_6", 1, 6), ("seasonal_7_12", 7, 12), ("second_year_13_24", 13, 24), ("third_year_25_36", 25, 36)]


def group_of(feature: str, groups: Mapping[str, Sequence[str]]) -> Column:
    """Feature to group as a CASE expression; an unknown feature gives null."""
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(F.col(feature).isin(list(members)), name).otherwise(out)
    return out


def linear_attribution(
    features: DataFrame, background: DataFrame, coefficients: DataFrame, keys: Sequence[str], keep_value: bool = False
) -> DataFrame:
    """Exact attributions of a linear model: coefficient x (value - background mean).

    `features` (keys, lag, feature, value); `coefficients` (run, lag, feature, coef) is a literal table.
    `keep_value` carries the input along, so that later contrasts need no join back.
    """
    means = background.groupBy("lag", "feature").agg(F.avg("value").alias("_mean"))
    weights = coefficients.join(means, ["lag", "feature"])
    # lags x features x runs rows: fixed by the model, not by the data
    return features.join(F.broadcast(weights), ["lag", "feature"]).select(
        "run", *keys, "lag", "feature", *(["value"] if keep_value else []), (F.col("coef") * (F.col("value") - F.col("_mean"))).alias("shap")
    )


def nested_attribution(
    samples: DataFrame, history: str, window: int, features: Sequence[str], background: DataFrame, coefficients: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """`linear_attribution` with its lags nested: one row (run, keys, feature, lags) per sample, run and feature.

    `history` is the array of `history_windows`; `lags` holds (lag, value, shap), newest first. Whatever adds up over a
    sample's lags is then a projection: no shuffle and no state per sample, where the long table needs a group for each.
    `features` lists what the arrays hold. The weights are model-sized: one row per run and feature.
    """
    means = background.groupBy("lag", "feature").agg(F.avg("value").alias("_mean"))
    lags = range(1, window + 1)
    weights = coefficients.join(means, ["lag", "feature"]).groupBy("run", "feature").agg(
        *[F.max(F.when(F.col("lag") == lag, F.struct("coef", "_mean"))).alias(f"_w{lag}") for lag in lags]
    )
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{history}.{f}").alias("_x")) for f in features])

    def cell(lag: int) -> Column:
        w, x = F.col(f"_w{lag}"), F.get("_x", F.lit(window - lag))
        return F.when(w.isNotNull(), F.struct(F.lit(lag).alias("lag"), x.alias("value"), (w["coef"] * (x - w["_mean"])).alias("shap")))

    long = samples.select(*keys, F.inline(cells)).join(F.broadcast(weights), "feature")
    return long.select("run", *keys, "feature", F.array(*[cell(lag) for lag in lags]).alias("lags"))


def _each(window: int, name: str) -> list[Column]:
    """One field of every lag, as plain expressions: Spark compiles them, which it does not do with lambdas over arrays."""
    return [F.get("lags", F.lit(i))[name] for i in range(window)]


def _sum(values: Sequence[Column]) -> Column:
    """Sum as SQL adds a group: nulls are left out, nothing but nulls gives null."""
    total = F.lit(0.0)
    for v in values:
        total = total + F.coalesce(v, F.lit(0.0))
    return F.when(F.coalesce(*values).isNotNull(), total)


def collapse_nested(df: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """`collapse_lags` of nested rows: a projection."""
    shap = _each(window, "shap")
    return df.select(*keys, "feature", _sum([F.abs(v) for v in shap]).alias("abs_shap"), _sum(shap).alias("signed_shap"))


def sample_levels(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per nested row: signed total and mean input, as `high_low_of` reads them.

    Both go over the array: written out per lag, the two make a method too large for the JVM to compile.
    """
    def total(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))

    def known(name: str) -> Column:
        return F.filter(F.col(f"lags.{name}").cast("array<double>"), lambda v: v.isNotNull())

    level = safe_divide(total(known("value")), F.size(known("value")))
    return df.select(*keys, "feature", total(known("shap")).alias("signed"), level.cast("float").cast("double").alias("level"))


def collapse_lags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sample and feature: sum of absolute values and sum of values over lags."""
    return df.groupBy(*keys, "feature").agg(F.sum(F.abs("shap")).alias("abs_shap"), F.sum("shap").alias("signed_shap"))


def _samples() -> Column:
    """Every sample carries lag 1 exactly once per feature."""
    return F.count(F.when(F.col("lag") == 1, 1))


def global_importance(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over samples of the lag total, signed mean, sign, direction and average-tie rank."""
    sums = df.groupBy(*by, "feature").agg(F.sum(F.abs("shap")).alias("_a"), F.sum("shap").alias("_s"), _samples().alias("n_samples"))
    out = sums.select(
        *by, "feature", "n_samples", safe_divide("_a", "n_samples").alias("mean_abs"), safe_divide("_s", "n_samples").alias("mean_signed")
    )
    out = average_rank(out, "mean_abs", "rank", by, descending=True, bounded=True)
    return out.withColumn("sign", sign_tol("mean_signed")).withColumn("direction", direction_text("mean_signed"))


def group_importance(df: DataFrame, by: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """The same for feature groups; a sample's group total is the sum over its members."""
    tagged = df.withColumn("group", group_of("feature", groups)).where(F.col("group").isNotNull())
    sums = tagged.groupBy(*by, "group", "feature").agg(F.sum(F.abs("shap")).alias("_a"), F.sum("shap").alias("_s"), _samples().alias("_n"))
    out = sums.groupBy(*by, "group").agg(
        join_sorted("feature").alias("members"), F.max("_n").alias("n_samples"),
        (F.sum("_a") / F.max("_n")).alias("mean_abs"), (F.sum("_s") / F.max("_n")).alias("mean_signed"),
    )
    out = average_rank(out, "mean_abs", "rank", by, descending=True, bounded=True)
    return out.withColumn("sign", sign_tol("mean_signed"))


def seed_aggregate(df: DataFrame, keys: Sequence[str], run: str, values: Sequence[str]) -> DataFrame:
    """Mean and sample SD across runs of aligned tables."""
    aggs = [F.count_distinct(run).alias("n_runs")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def high_low_contrast(df: DataFrame, by: Sequence[str], sample: Sequence[str], value: str = "value") -> DataFrame:
    """Mean signed attribution where the mean input is at or above q75 minus where it is at or below q25.

    Mean inputs are taken in single precision, so equal inputs stay equal whatever order they were summed in.
    """
    return high_low_of(df.groupBy(*by, *sample, "feature").agg(F.sum("shap").alias("signed"), F.avg(value).cast("float").cast("double").alias("level")), by)


def high_low_of(per: DataFrame, by: Sequence[str]) -> DataFrame:
    """`high_low_contrast` from one row (by, feature, signed, level) per sample; those are written once for both passes."""
    per = cut_lineage(per.select(*by, "feature", "signed", "level"))
    q = exact_quantiles(per, "level", {"q25": 0.25, "q75": 0.75}, by=[*by, "feature"]).drop("n")
    joined = per.join(broadcast_if_small(cut_lineage(q)), [*by, "feature"])
    out = joined.groupBy(*by, "feature").agg(
        F.avg(F.when(F.col("level") >= F.col("q75"), F.col("signed"))).alias("high"),
        F.avg(F.when(F.col("level") <= F.col("q25"), F.col("signed"))).alias("low"),
    )
    return out.withColumn("contrast", F.col("high") - F.col("low")).withColumn("contrast_sign", sign_tol("contrast"))


def lag_profile(df: DataFrame, by: Sequence[str], annual: Sequence[int] = (12, 24, 36)) -> DataFrame:
    return (
        df.groupBy(*by, "feature", "lag").agg(F.avg(F.abs("shap")).alias("mean_abs"), F.avg("shap").alias("mean_signed"))
        .withColumn("sign", sign_tol("mean_signed")).withColumn("annual_marker", F.col("lag").isin(list(annual)))
    )


def lag_pattern_summary(
    profile: DataFrame, importance: DataFrame, by: Sequence[str], leading: int = 5, top: int = 5,
    annual: Sequence[int] = (12, 24, 36), bands: Sequence[tuple[str, int, int]] = tuple(LAG_BANDS),
) -> DataFrame:
    """Peak lag, leading lags, annual share and dominant lag band of the leading features.

    Works on the lag profile, which has features x lags rows per run.
    """
    order = F.col("mean_abs").desc(), F.col("lag").asc()
    leaders = importance.where(F.col("rank") <= leading).select(*by, "feature", F.col("rank").alias("feature_rank"))
    mine = profile.join(leaders, [*by, "feature"])
    placed = mine.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "feature").orderBy(*order)))
    total = F.sum("mean_abs")
    annual_sum = F.coalesce(F.sum(F.when(F.col("lag").isin(list(annual)), F.col("mean_abs"))), F.lit(0.0))
    band = {n: F.coalesce(F.sum(F.when(F.col("lag").between(a, b), F.col("mean_abs"))), F.lit(0.0)) for n, a, b in bands}
    out = placed.groupBy(*by, "feature", "feature_rank").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("lag"))).alias("peak_lag"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_rn") <= top, F.struct("_rn", "lag")))), lambda s: s["lag"].cast("string")).alias("_top"),
        annual_sum.alias("annual_sum"), (annual_sum / total).alias("annual_share"), *[c.alias(n) for n, c in band.items()],
    )
    best = F.greatest(*[F.col(n) for n in band]) if len(band) > 1 else F.col(bands[0][0])
    label = F.lit(None).cast("string")
    for n in reversed(list(band)):
        label = F.when(F.col(n) == best, n).otherwise(label)
    return out.withColumn("top_lags", F.concat_ws(";", "_top")).withColumn("dominant_band", label).drop("_top")


def site_importance(df: DataFrame, by: Sequence[str], site: Sequence[str]) -> DataFrame:
    """Mean lag total per site and feature; sums first, so hot sites combine map-side."""
    return (
        df.groupBy(*by, *site, "feature").agg(F.sum(F.abs("shap")).alias("_a"), _samples().alias("n_samples"))
        .select(*by, *site, "feature", "n_samples", safe_divide("_a", "n_samples").alias("mean_abs"))
    )


def site_group_shares(
    site_features: DataFrame, by: Sequence[str], site: str, groups: Mapping[str, Sequence[str]], environmental: Sequence[str]
) -> DataFrame:
    """Group totals per site, share of the environmental total, the dominant group and its tie count.

    Windows run over the few groups of one site.
    """
    tagged = site_features.withColumn("group", group_of("feature", groups)).where(F.col("group").isin(list(environmental)))
    sums = tagged.groupBy(*by, site, "group").agg(F.sum("mean_abs").alias("group_abs"))
    w = Window.partitionBy(*by, site)
    top = F.max("group_abs").over(w)
    return (
        sums.withColumn("share", safe_divide(F.col("group_abs"), F.sum("group_abs").over(w)))
        .withColumn("dominant", (F.col("group_abs") == top).cast("int"))
        .withColumn("n_tied", F.sum((F.col("group_abs") == top).cast("int")).over(w))
    )


def dominant_feature(site_features: DataFrame, by: Sequence[str], site: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """Arg-max feature per site outside `excluded`, with the number of exact ties."""
    kept = site_features.where(~F.col("feature").isin(list(excluded))) if excluded else site_features
    cells = F.array_agg(F.struct(F.col("mean_abs"), F.col("feature")))
    per = kept.groupBy(*by, *site).agg(cells.alias("_c"), F.max("mean_abs").alias("dominant_abs"))  # one row per feature
    best = F.filter("_c", lambda c: c["mean_abs"] == F.col("dominant_abs"))
    return per.select(
        *by, *site, F.array_min(F.transform(best, lambda c: c["feature"])).alias("dominant_feature"), "dominant_abs",
        F.size(best).alias("n_tied"),
    )


def class_summary(shares: DataFrame, by: Sequence[str], group_class: str, environmental: Sequence[str]) -> DataFrame:
    """Per class and group: mean, share, dominance (first maximum in catalogue order), dominated sites.

    Sites carry every environmental group, so groups no site is dominated by appear with zero.
    """
    per = shares.groupBy(*by, group_class, "group").agg(
        F.count(F.lit(1)).alias("n_sites"), F.avg("group_abs").alias("mean_abs"), F.sum("dominant").cast("long").alias("dominant_sites")
    )
    w = Window.partitionBy(*by, group_class)
    rank = F.row_number().over(w.orderBy(F.col("mean_abs").desc(), F.array_position(F.array(*[F.lit(g) for g in environmental]), F.col("group"))))
    return (
        per.withColumn("share", safe_divide(F.col("mean_abs"), F.sum("mean_abs").over(w)))
        .withColumn("class_dominant", rank == 1)
        .withColumn("proportion", F.col("dominant_sites") / F.col("n_sites"))
    )


def class_top2(shares: DataFrame, by: Sequence[str], group_class: str) -> DataFrame:
    """Ranks with minimum ties, the two largest distinct shares, tied labels and the margin."""
    per = shares.groupBy(*by, group_class, "group").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("group_abs").alias("mean_abs"))
    w = Window.partitionBy(*by, group_class)
    per = per.withColumn("share", safe_divide(F.col("mean_abs"), F.sum("mean_abs").over(w)))
    ordered = w.orderBy(F.col("share").desc())
    per = per.withColumn("rank", F.rank().over(ordered)).withColumn("_d", F.dense_rank().over(ordered))
    for k in (1, 2):
        tied = F.collect_set(F.when(F.col("_d") == k, F.col("group"))).over(w)
        per = (
            per.withColumn(f"top{k}_group", F.array_join(F.array_sort(tied), ";"))
            .withColumn(f"top{k}_share", F.max(F.when(F.col("_d") == k, F.col("share"))).over(w))
            .withColumn(f"top{k}_ties", F.size(tied))
        )
    return per.withColumn("margin", F.col("top1_share") - F.col("top2_share")).drop("_d")


def share_matrix(top2: DataFrame, by: Sequence[str], group_class: str, groups: Sequence[str]) -> DataFrame:
    """Class x group shares, one column per group of the catalogue."""
    return top2.groupBy(*by, group_class).pivot("group", list(groups)).agg(F.first("share"))


def dominant_predictor_by_class(
    dominant: DataFrame, by: Sequence[str], group_class: str, categories: Mapping[str, str], other: str = "other"
) -> DataFrame:
    """Counts and proportions per class of predictors and of continuity categories; most frequent predictors marked."""
    category = F.lit(other)
    for feature, name in categories.items():
        category = F.when(F.col("dominant_feature") == feature, name).otherwise(category)
    cells = F.array(
        F.struct(F.lit("predictor").alias("record_type"), F.col("dominant_feature").alias("name")),
        F.struct(F.lit("category").alias("record_type"), category.alias("name")),
    )
    counts = dominant.select(*by, group_class, F.inline(cells)).groupBy(*by, group_class, "record_type", "name").agg(F.count(F.lit(1)).alias("n_sites_dominant"))
    w = Window.partitionBy(*by, group_class, "record_type")
    return (
        counts.withColumn("n_sites", F.sum("n_sites_dominant").over(w))
        .withColumn("proportion", F.col("n_sites_dominant") / F.col("n_sites"))
        .withColumn("most_frequent", F.col("n_sites_dominant") == F.max("n_sites_dominant").over(w))
    )


def category_stability(by_class: DataFrame, run: str, group_class: str, names: Sequence[str]) -> DataFrame:
    """Range over runs of each category's proportion, and whether the most frequent predictor agrees."""
    cats = by_class.where(F.col("record_type") == "category")
    wide = cats.groupBy(group_class, run).agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("proportion"))), F.lit(0.0)).alias(n) for n in names])
    aggs = []
    for n in names:
        aggs += [F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"), (F.max(n) - F.min(n)).alias(f"{n}_range")]
    ranges = wide.groupBy(group_class).agg(F.count(F.lit(1)).alias("n_runs"), *aggs)
    tops = by_class.where((F.col("record_type") == "predictor") & F.col("most_frequent")).groupBy(group_class, run).agg(join_sorted("name").alias("_top"))
    same = tops.groupBy(group_class).agg((F.count_distinct("_top") == 1).alias("consistent"), join_sorted("_top", "|").alias("labels"))
    return ranges.join(same, group_class)


def filter_attributions(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every lag and feature of the affected samples."""
    return df.join(excluded.select(*keys), list(keys), "left_anti")


def raw_and_grouped(features: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """One long table of variable and group importances."""
    cols = ["mean_abs", "mean_signed", "sign", "rank"]
    a = features.select(*by, F.lit("variable").alias("entity_type"), F.col("feature").alias("entity"), *cols)
    b = groups.select(*by, F.lit("group").alias("entity_type"), F.col("group").alias("entity"), *cols)
    return a.unionByName(b)


def cross_check(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float = 2e-6) -> DataFrame:
    """Recomputed against stored values: absolute and relative difference, within tolerance or not."""
    joined = a.select(*keys, F.col(value).alias("recomputed")).join(b.select(*keys, F.col(value).alias("stored")), list(keys), "full_outer")
    d = F.abs(F.col("recomputed") - F.col("stored"))
    return (
        joined.withColumn("abs_difference", d).withColumn("rel_difference", safe_divide(d, F.abs(F.col("stored"))))
        .withColumn("within", F.coalesce(d <= F.lit(tol) + F.lit(tol) * F.abs(F.col("stored")), F.lit(False)))
    )
