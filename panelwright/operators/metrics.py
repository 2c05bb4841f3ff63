"""Regression metrics, selections, diagnostics and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import correlation, finite, safe_divide
from panelwright.operators.ordering import exact_quantiles, running_sum
from panelwright.operators.temporal import attach_row

METRICS = ["rmse", "mae", "r2", "bias", "pearson_r"]
SUMS = ["n", "s_y", "s_yy", "s_p", "s_pp", "s_yp", "s_ee", "s_ae", "s_e"]


def complete_pair(truth: str, prediction: str) -> tuple[Column, Column]:
    """Truth and prediction where both are finite, else null: every sum and count below runs over the same pairs."""
    both = finite(truth) & finite(prediction)
    return F.when(both, F.col(truth).cast("double")), F.when(both, F.col(prediction).cast("double"))


def _metric_aggs(truth: str, prediction: str) -> list[Column]:
    """One pass; the built-in moments merge without cancellation, though not to an exact zero for equal values."""
    y, p = complete_pair(truth, prediction)
    e = p - y
    sst = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / F.when((F.min(y) < F.max(y)) & (sst > 0), sst)).alias("r2"), F.avg(e).alias("bias"),
        correlation(y, p).alias("pearson_r"),
    ]


def regression_metrics(df: DataFrame, by: Sequence[str] = (), truth: str = "y_true", prediction: str = "y_pred") -> DataFrame:
    """n, RMSE, MAE, R2, bias, r over finite pairs; R2 and r are null without variance. A group without pairs has n = 0."""
    return df.groupBy(*by).agg(*_metric_aggs(truth, prediction))


def mean_sd_over(metrics: DataFrame, by: Sequence[str], cols: Sequence[str] = METRICS, more: Sequence[Column] = ()) -> DataFrame:
    """Mean and sample SD across the seeds that have pairs."""
    aggs = [F.count(F.when(F.col("n") > 0, 1)).alias("n_seeds"), F.max("n").alias("records_per_seed")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return metrics.groupBy(*by).agg(*aggs, *more)


def metrics_mean_sd(
    df: DataFrame, by: Sequence[str], seed: str = "seed", entity: str | None = None, truth: str = "y_true", prediction: str = "y_pred"
) -> DataFrame:
    """Per-seed metrics, then mean and sample SD, with records and entities of a seed."""
    if not entity:
        return mean_sd_over(df.groupBy(*by, seed).agg(*_metric_aggs(truth, prediction)), by)
    paired = F.when(complete_pair(truth, prediction)[0].isNotNull(), F.col(entity))
    per = df.groupBy(*by, seed).agg(*_metric_aggs(truth, prediction), F.count_distinct(paired).alias("entities"))
    return mean_sd_over(per, by, more=[F.max("entities").alias("entities")])


def grouped_metrics(
    df: DataFrame, groupings: Sequence[str], seed: str = "seed", truth: str = "y_true", prediction: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Summaries per level of `by` over all rows and over each grouping column, from one set of grouping sets."""
    y, p = F.col(truth), F.col(prediction)
    base = df.select(*by, seed, *groupings, y.alias("_y"), p.alias("_p"))
    always = [F.col(c) for c in (*by, seed)]
    sets = [always, *[[*always, F.col(g)] for g in groupings]]
    aggs = _metric_aggs("_y", "_p")
    per = base.groupingSets(sets, *always, *[F.col(g) for g in groupings]).agg(F.grouping_id().alias("_gid"), *aggs)
    # grouping_id marks the columns left out of a set, first column in the highest bit
    full = (1 << len(groupings)) - 1
    name, level = F.lit("all"), F.lit("all")
    for i, g in enumerate(groupings):
        mine = full & ~(1 << (len(groupings) - 1 - i))
        name = F.when(F.col("_gid") == mine, g).otherwise(name)
        level = F.when(F.col("_gid") == mine, F.col(g).cast("string")).otherwise(level)
    per = per.select(*by, name.alias("grouping"), level.alias("level"), seed, "n", *METRICS)
    return mean_sd_over(per, [*by, "grouping", "level"])


def cluster_sufficient_stats(
    df: DataFrame, by: Sequence[str], truth: str = "y_true", prediction: str = "y_pred", center: Column | float = 0.0
) -> DataFrame:
    """Nine additive sums over the finite pairs of a cluster, zero without pairs. `center` is subtracted from truth and prediction first, which
    leaves every metric unchanged and avoids cancellation when the mean is large."""
    c = F.lit(center) if isinstance(center, (int, float)) else center
    truth_, prediction_ = complete_pair(truth, prediction)
    rows = df.select(*by, (truth_ - c).alias("_y"), (prediction_ - c).alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    e = p - y
    sums = {"s_y": y, "s_yy": y * y, "s_p": p, "s_pp": p * p, "s_yp": y * p, "s_ee": e * e, "s_ae": F.abs(e), "s_e": e}
    return rows.groupBy(*by).agg(F.count(y).cast("double").alias("n"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()])


def metrics_from_sums(sums: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The metrics as a projection of the nine sums."""
    n = F.when(F.col("n") > 0, F.col("n"))
    syy = F.col("s_yy") - F.col("s_y") * F.col("s_y") / n
    spp = F.col("s_pp") - F.col("s_p") * F.col("s_p") / n
    syp = F.col("s_yp") - F.col("s_y") * F.col("s_p") / n
    return sums.select(
        *keep, "n", F.sqrt(F.col("s_ee") / n).alias("rmse"), (F.col("s_ae") / n).alias("mae"),
        (F.lit(1.0) - F.col("s_ee") / F.when(syy > 0, syy)).alias("r2"), (F.col("s_e") / n).alias("bias"),
        F.when((syy > 0) & (spp > 0), syp / F.sqrt(F.when((syy > 0) & (spp > 0), syy * spp))).alias("pearson_r"),
    )


def dual_domain_table(
    df: DataFrame, excluded: Column, model: str = "model", seed: str = "seed", deterministic: Sequence[str] = ()
) -> DataFrame:
    """Every model in the clean and the full domain; a deterministic model is scored once, as one run without SD."""
    domains = F.array(F.lit("full"), F.lit("clean"))
    both = df.withColumn("_x", F.coalesce(excluded, F.lit(False))).withColumn("domain", F.explode(domains))
    both = both.where((F.col("domain") == "full") | ~F.col("_x"))
    # the rows of a deterministic model repeat per seed: its smallest seed stands for all
    fixed = F.col(model).isin(list(deterministic))
    per = regression_metrics(both, [model, "domain", seed])
    once = F.struct(seed, "n", *METRICS)
    first = per.where(fixed & (F.col("n") > 0)).groupBy(model, "domain").agg(F.min(once).alias("_r")).select(model, "domain", "_r.*")
    return mean_sd_over(per.where(~fixed).unionByName(first), [model, "domain"])


def oof_metrics(df: DataFrame, fold: str = "fold", seed: str = "seed", arm: str | None = None) -> DataFrame:
    """Out-of-fold metrics: every fold and the pooled table per seed, then mean and SD over seeds."""
    lead = [arm] if arm else []
    scope = F.array(F.concat(F.lit("fold_"), F.col(fold).cast("string")), F.lit("pooled"))
    long = df.withColumn("scope", F.explode(scope))
    return mean_sd_over(regression_metrics(long, [*lead, "scope", seed]), [*lead, "scope"])


# --- selection ------------------------------------------------------------------------------

def select_best(df: DataFrame, candidate: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """All candidates with their statistics; lowest mean, then median, then the smaller candidate."""
    stats = df.groupBy(*by, candidate).agg(
        F.count(score).alias("n_scores"), F.avg(score).alias("mean"), F.percentile(score, 0.5).alias("median"),
        F.stddev_samp(score).alias("sd"), F.min(score).alias("min"), F.max(score).alias("max"),
    )
    # a handful of candidates per group
    order = Window.partitionBy(*by).orderBy("mean", "median", candidate)
    return stats.withColumn("position", F.row_number().over(order)).withColumn("selected", F.col("position") == 1)


def grid_winner(df: DataFrame, by: Sequence[str], score: str, tie_breaks: Sequence[Column]) -> DataFrame:
    """Best row of each hyper-parameter grid with tie-breaks in order; `tie` tells whether any scores repeat."""
    # a grid holds a few dozen settings
    grid = Window.partitionBy(*by)
    ranked = df.withColumn("tie", F.size(F.collect_set(score).over(grid)) < F.count(score).over(grid))
    ranked = ranked.withColumn("_rn", F.row_number().over(grid.orderBy(F.col(score).asc(), *tie_breaks)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def highest_by(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The row with the maximum finite value of each group, as an aggregate (no window, no sort); of ties the first by `tie`."""
    rest = [c for c in df.columns if c not in by]
    order = F.struct((-F.col(value)).alias("_v"), *[F.col(t) for t in tie])
    return df.where(finite(value)).groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


# --- diagnostics ----------------------------------------------------------------------------

def residual_diagnostics(df: DataFrame, residual: str, fitted: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per level of `by`, few and not null: moments with the sample SD, quantiles, extremes, share of the largest square."""
    r, f = F.col(residual), F.col(fitted)
    n = F.count(r)
    ratio = (n - 1) / n
    moments = df.groupBy(*by).agg(
        n.alias("n"), F.avg(r).alias("residual_mean"), F.stddev_samp(r).alias("residual_sd"), F.min(r).alias("residual_min"),
        F.max(r).alias("residual_max"),
        (F.skewness(r) * F.pow(ratio, F.lit(1.5))).alias("residual_skewness"),
        ((F.kurtosis(r) + 3) * ratio * ratio - 3).alias("residual_excess_kurtosis"),
        (F.max(r * r) / F.sum(r * r)).alias("largest_squared_share"), F.min(f).alias("fitted_min"), F.max(f).alias("fitted_max"),
        correlation(r, f).alias("residual_fitted_correlation"),
    )
    q = exact_quantiles(df, residual, {"residual_q01": 0.01, "residual_q25": 0.25, "residual_median": 0.5, "residual_q75": 0.75, "residual_q99": 0.99}, by)
    return moments.join(q.drop("n"), list(by)) if by else attach_row(moments, q.drop("n"))


def attempt_ledger(df: DataFrame, attempt: str, success: str, category: str, target: int, batch: int = 50, max_failure: float = 0.05) -> DataFrame:
    """One row: attempts used until `target` successes, failures, structural errors, first-batch verdict."""
    rows = df.select(attempt, category, F.col(success).cast("int").alias("_s"))
    ran = running_sum(rows, F.col("_s"), [attempt], "_done")
    used = ran.where(F.col("_done") - F.col("_s") < target)
    structural = F.col(category) == "STRUCTURAL_ERROR"
    first = F.col(attempt) <= batch
    out = used.agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("_s").cast("long").alias("successes"), F.sum(1 - F.col("_s")).cast("long").alias("failures"),
        F.count(F.when(structural, 1)).alias("structural_errors"), F.avg(F.when(first, 1 - F.col("_s"))).alias("first_batch_failure_rate"),
    )
    return (
        out.withColumn("failure_rate", safe_divide(F.col("failures"), F.col("attempts")))
        .withColumn("target_reached", F.col("successes") >= target)
        .withColumn("verdict", F.when((F.col("structural_errors") == 0) & (F.col("first_batch_failure_rate") <= max_failure), "PASS_CONTINUE").otherwise("STOP"))
    )


def bootstrap_summary(draws: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, SD, percentile interval, extremes and sign fractions of replicates."""
    v = F.col(value)
    return draws.groupBy(*by).agg(
        F.count(v).alias("n_success"), F.count(F.lit(1)).alias("n_attempt"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"),
        F.stddev_samp(v).alias("sd"), F.percentile(v, 0.025).alias("lower"), F.percentile(v, 0.975).alias("upper"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(F.when(v.isNotNull(), (v < 0).cast("int"))).alias("negative_fraction"), F.avg(F.when(v.isNotNull(), (v > 0).cast("int"))).alias("positive_fraction"),
    )


def range_summary(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """min / median / mean / max of stability measures per family."""
    aggs = []
    for v in values:
        aggs += [F.min(v).alias(f"{v}_min"), F.percentile(v, 0.5).alias(f"{v}_median"), F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*by).agg(*aggs)
