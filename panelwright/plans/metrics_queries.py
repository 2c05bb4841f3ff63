"""Metrics, selections, diagnostics and summaries of the prediction table."""

from pyspark.sql import functions as F

from panelwright.operators import metrics as op
from panelwright.operators.ordering import dense_index
from panelwright.operators.temporal import affected_by_invalid
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.tables import MEAN_SD_DOUBLES, MEAN_SD_SQL, METRICS_SQL, SEED, Tables, with_

M = "rmse mae r2 bias pearson_r"
P = T.PREDICTIONS


@query("g01_regression_metrics", with_(P, f"SELECT model, seed, fold, {METRICS_SQL} FROM predictions GROUP BY ALL"), M)
def regression_metrics(t: Tables):
    return op.regression_metrics(t.predictions, ["model", "seed", "fold"])


@query("g02_metrics_mean_sd", with_(P, f"SELECT model, year, {MEAN_SD_SQL}, max(entities) AS entities FROM (SELECT model, year, seed, {METRICS_SQL}, count(DISTINCT site) FILTER (WHERE y_pred IS NOT NULL) AS entities FROM predictions GROUP BY ALL) GROUP BY ALL"), MEAN_SD_DOUBLES)
def metrics_mean_sd(t: Tables):
    return op.metrics_mean_sd(t.predictions, ["model", "year"], entity="site")


GROUPINGS = ["month", "year", "decile", "fold"]


def _deciles(t: Tables):
    """Deciles of the truth, which all models and seeds share, attached to every row."""
    rows = t.predictions
    first = rows.where((F.col("model") == "site_month") & (F.col("seed") == 1)).select("site", "period", "y_true")
    placed = dense_index(first, ["y_true", "site", "period"], "_i")
    n = first.select(F.count(F.lit(1))).scalar()
    deciles = placed.select("site", "period", (F.floor(F.col("_i") * 10 / n) + 1).cast("int").alias("decile"))
    return rows.join(deciles, ["site", "period"])


_DEC = f""", dec AS (SELECT site, period, (floor((row_number() OVER (ORDER BY y_true, site, period) - 1) * 10 / count(*) OVER ()) + 1)::INT AS decile FROM predictions WHERE model = 'site_month' AND seed = 1),
  pd AS (SELECT p.*, decile FROM predictions p JOIN dec USING (site, period))"""


@query("g03_grouped_metrics", with_(P + _DEC, f"SELECT model, grouping, level, {MEAN_SD_SQL} FROM (" + " UNION ALL ".join(
    f"SELECT model, '{g}' AS grouping, {e} AS level, seed, {METRICS_SQL} FROM pd GROUP BY ALL" for g, e in [("all", "'all'")] + [(c, f"{c}::VARCHAR") for c in GROUPINGS]
) + ") GROUP BY ALL"), MEAN_SD_DOUBLES)
def grouped_metrics(t: Tables):
    return op.grouped_metrics(_deciles(t), GROUPINGS, by=["model"])


SUMS_SQL = T.sums_sql(3.0)
SUM_DOUBLES = " ".join(op.SUMS)


@query("g04_cluster_sufficient_stats", with_(P, f"SELECT model, seed, site, {SUMS_SQL} FROM predictions GROUP BY ALL"), SUM_DOUBLES)
def sufficient(t: Tables):
    return op.cluster_sufficient_stats(t.predictions, ["model", "seed", "site"], center=3.0)


@query("g05_metrics_from_sums", with_(P, f"SELECT model, month, n, rmse, mae, r2, bias, pearson_r FROM (SELECT model, month, {METRICS_SQL.replace('count(y_pred) AS n', 'count(y_pred)::DOUBLE AS n')} FROM predictions GROUP BY ALL)"), "n " + M)
def from_sums(t: Tables):
    return op.metrics_from_sums(op.cluster_sufficient_stats(t.predictions, ["model", "month"], center=3.0), ["model", "month"])


@query("g06_dual_domain_table", with_(P + ", " + T.INVALID + ", " + T.excluded(12), f"""SELECT model, domain, {MEAN_SD_SQL} FROM (
  SELECT model, 'full' AS domain, seed, {METRICS_SQL} FROM predictions WHERE model <> 'month' OR seed = 1 GROUP BY ALL UNION ALL
  SELECT model, 'clean', seed, {METRICS_SQL} FROM predictions p WHERE (model <> 'month' OR seed = 1) AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.site = p.site AND e.period = p.period) GROUP BY ALL) GROUP BY ALL"""), MEAN_SD_DOUBLES)
def dual_domain(t: Tables):
    marked = affected_by_invalid(t.predictions, t.invalid, ["site"], "period", 12)
    return op.dual_domain_table(marked, F.col("affected"), deterministic=["month"])


@query("g07_oof_metrics", with_(P, f"""SELECT model, scope, {MEAN_SD_SQL} FROM (SELECT model, 'fold_' || fold AS scope, seed, {METRICS_SQL} FROM predictions GROUP BY ALL UNION ALL
  SELECT model, 'pooled', seed, {METRICS_SQL} FROM predictions GROUP BY ALL) GROUP BY ALL"""), MEAN_SD_DOUBLES)
def oof(t: Tables):
    return op.oof_metrics(t.predictions, arm="model")


SCORES = f", scores AS (SELECT model, fold, month AS window_id, seed, avg((y_pred - y_true) * (y_pred - y_true)) AS mse FROM predictions GROUP BY ALL)"


def _scores(t: Tables):
    return t.predictions.groupBy("model", "fold", F.col("month").alias("window_id"), "seed").agg(F.avg((F.col("y_pred") - F.col("y_true")) * (F.col("y_pred") - F.col("y_true"))).alias("mse"))


@query("g08_select_best", with_(P + SCORES, """SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY mean, median, window_id)::INT AS position, row_number() OVER (PARTITION BY model, fold ORDER BY mean, median, window_id) = 1 AS selected FROM (
  SELECT model, fold, window_id, count(*) AS n_scores, avg(mse) AS mean, quantile_cont(mse, 0.5) AS median, stddev_samp(mse) AS sd, min(mse) AS min, max(mse) AS max FROM scores GROUP BY ALL)"""), "mean median sd min max")
def select_best(t: Tables):
    return op.select_best(_scores(t), "window_id", "mse", ["model", "fold"])


@query("g09_grid_winner", with_(T.PANEL, """, grid AS (SELECT class, month AS width, year AS depth, max(load) AS score FROM panel GROUP BY ALL)
  SELECT class, width, depth, score, tie FROM (SELECT *, count(DISTINCT score) OVER (PARTITION BY class) < count(*) OVER (PARTITION BY class) AS tie,
    row_number() OVER (PARTITION BY class ORDER BY score, width, depth DESC) AS rn FROM grid) WHERE rn = 1"""), "score")
def grid_winner(t: Tables):
    grid = t.panel.groupBy("class", F.col("month").alias("width"), F.col("year").alias("depth")).agg(F.max("load").alias("score"))
    return op.grid_winner(grid, ["class"], "score", [F.col("width").asc(), F.col("depth").desc()])


RES = ", res AS (SELECT model, seed, y_pred - y_true AS r, y_pred AS f FROM predictions)"


@query("g10_residual_diagnostics", with_(P + RES, """SELECT model, seed, count(r) AS n, avg(r) AS residual_mean, stddev_samp(r) AS residual_sd, min(r) AS residual_min, max(r) AS residual_max,
    avg(pow(r - m, 3)) / pow(stddev_samp(r), 3) AS residual_skewness, avg(pow(r - m, 4)) / pow(stddev_samp(r), 4) - 3 AS residual_excess_kurtosis, max(r * r) / sum(r * r) AS largest_squared_share,
    min(f) AS fitted_min, max(f) AS fitted_max, corr(r, f) AS residual_fitted_correlation, quantile_cont(r, 0.01) AS residual_q01, quantile_cont(r, 0.25) AS residual_q25, quantile_cont(r, 0.5) AS residual_median,
    quantile_cont(r, 0.75) AS residual_q75, quantile_cont(r, 0.99) AS residual_q99 FROM res JOIN (SELECT model, seed, avg(r) AS m FROM res GROUP BY ALL) USING (model, seed) GROUP BY model, seed"""),
    "residual_mean residual_sd residual_min residual_max residual_skewness residual_excess_kurtosis largest_squared_share fitted_min fitted_max residual_fitted_correlation residual_q01 residual_q25 residual_median residual_q75 residual_q99")
def diagnostics(t: Tables):
    return op.residual_diagnostics(t.predictions.select("model", "seed", (F.col("y_pred") - F.col("y_true")).alias("r"), F.col("y_pred").alias("f")), "r", "f", ["model", "seed"])


@query("g11_attempt_ledger", """WITH a AS (SELECT attempt, ok, msg, sum(ok) OVER (ORDER BY attempt) AS done FROM (
    SELECT (o_custkey + 1)::BIGINT AS attempt, (count(*) FILTER (WHERE o_orderstatus = 'F') > 0)::INT AS ok, CASE WHEN min(o_orderpriority) = '5-LOW' THEN 'STRUCTURAL_ERROR' ELSE 'FIT_ERROR' END AS msg FROM orders GROUP BY o_custkey))
  SELECT *, failures::DOUBLE / attempts AS failure_rate, successes >= 1000 AS target_reached, CASE WHEN structural_errors = 0 AND first_batch_failure_rate <= 0.05 THEN 'PASS_CONTINUE' ELSE 'STOP' END AS verdict FROM (
    SELECT count(*) AS attempts, sum(ok)::BIGINT AS successes, sum(1 - ok)::BIGINT AS failures, count(CASE WHEN msg = 'STRUCTURAL_ERROR' THEN 1 END) AS structural_errors, avg(CASE WHEN attempt <= 50 THEN 1 - ok END) AS first_batch_failure_rate
    FROM a WHERE done - ok < 1000)""", "failure_rate first_batch_failure_rate")
def ledger(t: Tables):
    rows = t.raw("orders", "o_custkey", "o_orderstatus", "o_orderpriority").groupBy((F.col("o_custkey") + 1).alias("attempt")).agg(
        (F.count(F.when(F.col("o_orderstatus") == "F", 1)) > 0).alias("success"),
        F.when(F.min("o_orderpriority") == "5-LOW", "STRUCTURAL_ERROR").otherwise("FIT_ERROR").alias("category"),
    )
    return op.attempt_ledger(rows, "attempt", "success", "category", 1000)


@query("g12_bootstrap_summary", with_(T.PANEL, """SELECT class, count(v) AS n_success, count(*) AS n_attempt, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS sd, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper,
    min(v) AS min, max(v) AS max, avg((v < 0)::INT) AS negative_fraction, avg((v > 0)::INT) AS positive_fraction FROM (SELECT class, period, CASE WHEN count(*) > 2 THEN avg(net) END AS v FROM panel GROUP BY ALL) GROUP BY class"""),
    "mean median sd lower upper min max negative_fraction positive_fraction")
def bootstrap_summary(t: Tables):
    values = t.panel.groupBy("class", "period").agg(F.when(F.count(F.lit(1)) > 2, F.avg("net")).alias("v"))
    return op.bootstrap_summary(values, "v", ["class"])


@query("g13_range_summary", with_(P, f"""SELECT model, min(rmse) AS rmse_min, quantile_cont(rmse, 0.5) AS rmse_median, avg(rmse) AS rmse_mean, max(rmse) AS rmse_max, min(mae) AS mae_min, quantile_cont(mae, 0.5) AS mae_median, avg(mae) AS mae_mean, max(mae) AS mae_max
  FROM (SELECT model, fold, seed, {METRICS_SQL} FROM predictions GROUP BY ALL) GROUP BY model"""), "rmse_min rmse_median rmse_mean rmse_max mae_min mae_median mae_mean mae_max")
def range_summary(t: Tables):
    return op.range_summary(op.regression_metrics(t.predictions, ["model", "fold", "seed"]), ["model"], ["rmse", "mae"])


@query("g14_highest_by", with_(T.PANEL, "SELECT class, site, period, load FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY load DESC, site, period) AS rn FROM panel) WHERE rn = 1"), "load")
def highest_by(t: Tables):
    return op.highest_by(t.panel.select("class", "site", "period", "load"), ["class"], "load", ["site", "period"])
