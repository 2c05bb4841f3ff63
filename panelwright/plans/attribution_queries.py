"""Attribution roll-ups over all samples, lags, features and runs."""

from pyspark.sql import functions as F

from panelwright.operators import attribution as op
from panelwright.operators.temporal import exclusion_keys
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.resampling_queries import SHARES, site_shares
from panelwright.plans.tables import FEATURES, GROUPS, WINDOW, Tables, with_

ENV = list(GROUPS)
BANDS = [("recent", 1, 2), ("middle", 3, 4), ("old", 5, 6)]
ANNUAL = [3, 6]
A = T.ATTRIBUTIONS
GROUP_CASE = "CASE feature WHEN 'water' THEN 'Hydrologic' WHEN 'energy' THEN 'Energy' WHEN 'heat' THEN 'Thermal' ELSE 'Activity' END"
SIGN = "CASE WHEN {c} > 1e-12 THEN 1 WHEN {c} < -1e-12 THEN -1 ELSE 0 END"
AVG_RANK = "rank() OVER (PARTITION BY run ORDER BY mean_abs DESC) + (count(*) OVER (PARTITION BY run, mean_abs) - 1) / 2.0::DOUBLE"

IMPORTANCE = f""", imp0 AS (SELECT run, feature, count(CASE WHEN lag = 1 THEN 1 END) AS n_samples, sum(abs(shap)) / count(CASE WHEN lag = 1 THEN 1 END) AS mean_abs, sum(shap) / count(CASE WHEN lag = 1 THEN 1 END) AS mean_signed FROM attributions GROUP BY ALL),
  importance AS (SELECT *, {AVG_RANK} AS rank, {SIGN.format(c='mean_signed')} AS sign FROM imp0),
  gimp0 AS (SELECT run, {GROUP_CASE} AS "group", string_agg(feature, ';' ORDER BY feature) AS members, max(n_samples) AS n_samples, sum(mean_abs) AS mean_abs, sum(mean_signed) AS mean_signed FROM imp0 GROUP BY ALL),
  gimportance AS (SELECT *, {AVG_RANK} AS rank, {SIGN.format(c='mean_signed')} AS sign FROM gimp0)"""


@query("i01_collapse_lags", with_(A, "SELECT run, site, period, feature, sum(abs(shap)) AS abs_shap, sum(shap) AS signed_shap FROM attributions GROUP BY ALL"), "abs_shap signed_shap")
def collapse(t: Tables):
    return op.collapse_nested(t.nested_attributions, ["run", "site", "period"], WINDOW)


@query("i02_global_importance", with_(A + IMPORTANCE, "SELECT *, CASE sign WHEN 1 THEN 'positive mean attribution' WHEN -1 THEN 'negative mean attribution' ELSE 'near-zero mean attribution' END AS direction FROM importance"), "mean_abs mean_signed rank")
def global_importance(t: Tables):
    return op.global_importance(t.attributions, ["run"])


@query("i03_group_importance", with_(A + IMPORTANCE, "SELECT * FROM gimportance"), "mean_abs mean_signed rank")
def group_importance(t: Tables):
    return op.group_importance(t.attributions, ["run"], GROUPS)


@query("i04_rank_average_ties", with_(T.PANEL, "SELECT site, period, load, rank() OVER (ORDER BY load DESC) + (count(*) OVER (PARTITION BY load) - 1) / 2.0::DOUBLE AS rank FROM panel"), "load rank")
def average_ties(t: Tables):
    from panelwright.operators.ordering import average_rank

    return average_rank(t.panel.select("site", "period", "load"), "load", descending=True)


@query("i04_rank_minimum_ties", with_(T.PANEL, "SELECT class, site, period, load, (rank() OVER (PARTITION BY class ORDER BY load))::DOUBLE AS rank FROM panel"), "load rank")
def minimum_ties(t: Tables):
    from panelwright.operators.ordering import average_rank

    return average_rank(t.panel.select("class", "site", "period", "load"), "load", by=["class"], ties="min")


@query("i05_seed_aggregate", with_(A + IMPORTANCE, "SELECT feature, count(DISTINCT run) AS n_runs, avg(mean_abs) AS mean_abs_mean, stddev_samp(mean_abs) AS mean_abs_sd, avg(mean_signed) AS mean_signed_mean, stddev_samp(mean_signed) AS mean_signed_sd FROM importance GROUP BY feature"), "mean_abs_mean mean_abs_sd mean_signed_mean mean_signed_sd")
def seed_aggregate(t: Tables):
    return op.seed_aggregate(op.global_importance(t.attributions, ["run"]), ["feature"], "run", ["mean_abs", "mean_signed"])


@query("i06_high_low_contrast", with_(A, f""", per AS (SELECT a.run, a.site, a.period, a.feature, sum(shap) AS signed, avg(value)::FLOAT::DOUBLE AS level FROM attributions a JOIN features_long f USING (site, period, lag, feature) GROUP BY ALL),
  q AS (SELECT run, feature, quantile_cont(level, 0.25) AS q25, quantile_cont(level, 0.75) AS q75 FROM per GROUP BY ALL)
  SELECT *, high - low AS contrast, {SIGN.format(c='high - low')} AS contrast_sign FROM (SELECT run, feature, avg(CASE WHEN level >= q75 THEN signed END) AS high, avg(CASE WHEN level <= q25 THEN signed END) AS low FROM per JOIN q USING (run, feature) GROUP BY ALL)"""), "high low contrast", digits=6)
def high_low(t: Tables):
    return op.high_low_of(op.sample_levels(t.nested_attributions, ["run", "site", "period"]), ["run"])


PROFILE = f", profile AS (SELECT run, feature, lag, avg(abs(shap)) AS mean_abs, avg(shap) AS mean_signed FROM attributions GROUP BY ALL)"


@query("i07_lag_profile", with_(A + PROFILE, f"SELECT *, {SIGN.format(c='mean_signed')} AS sign, lag IN (3, 6) AS annual_marker FROM profile"), "mean_abs mean_signed")
def lag_profile(t: Tables):
    return op.lag_profile(t.attributions, ["run"], ANNUAL)


@query("i08_lag_pattern_summary", with_(A + IMPORTANCE + PROFILE, """, lead AS (SELECT p.*, i.rank AS feature_rank, row_number() OVER (PARTITION BY p.run, p.feature ORDER BY p.mean_abs DESC, lag) AS rn FROM profile p JOIN importance i USING (run, feature) WHERE i.rank <= 3)
  SELECT *, CASE WHEN recent = greatest(recent, middle, old) THEN 'recent' WHEN middle = greatest(recent, middle, old) THEN 'middle' ELSE 'old' END AS dominant_band FROM (
  SELECT run, feature, feature_rank, max(CASE WHEN rn = 1 THEN lag END) AS peak_lag, string_agg(CASE WHEN rn <= 3 THEN lag::VARCHAR END, ';' ORDER BY rn) AS top_lags, sum(CASE WHEN lag IN (3, 6) THEN mean_abs ELSE 0 END) AS annual_sum,
    sum(CASE WHEN lag IN (3, 6) THEN mean_abs ELSE 0 END) / sum(mean_abs) AS annual_share, sum(CASE WHEN lag <= 2 THEN mean_abs ELSE 0 END) AS recent, sum(CASE WHEN lag BETWEEN 3 AND 4 THEN mean_abs ELSE 0 END) AS middle,
    sum(CASE WHEN lag >= 5 THEN mean_abs ELSE 0 END) AS old FROM lead GROUP BY ALL)"""), "feature_rank annual_sum annual_share recent middle old")
def lag_pattern(t: Tables):
    return op.lag_pattern_summary(op.lag_profile(t.attributions, ["run"], ANNUAL), op.global_importance(t.attributions, ["run"]), ["run"], 3, 3, ANNUAL, BANDS)


_PR = """, pr AS (SELECT p.*, a.feature, a.lag, a.mean_abs AS x, b.mean_abs AS y, row_number() OVER (ORDER BY left_run, right_run, a.feature, a.lag) AS rid
    FROM (VALUES ('model_seed', 'r1', 'r2'), ('model_seed', 'r1', 'r3')) p(family, left_run, right_run) JOIN profile a ON a.run = left_run JOIN profile b ON b.run = right_run AND b.feature = a.feature AND b.lag = a.lag),
  rk AS (SELECT *, rank() OVER (PARTITION BY right_run, feature ORDER BY x) + (count(*) OVER (PARTITION BY right_run, feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY right_run, feature ORDER BY y) + (count(*) OVER (PARTITION BY right_run, feature, y) - 1) / 2.0::DOUBLE AS ry FROM pr),
  base AS (SELECT family, left_run, right_run, feature, arg_max(lag, x) AS left_peak, arg_max(lag, y) AS right_peak, sum(CASE WHEN lag IN (3, 6) THEN x ELSE 0 END) / sum(x) AS left_annual_share, sum(CASE WHEN lag IN (3, 6) THEN y ELSE 0 END) / sum(y) AS right_annual_share,
    arg_max(lag, x) = arg_max(lag, y) AS peak_match, corr(rx, ry) AS spearman FROM rk GROUP BY ALL),
  tau AS (SELECT a.right_run, a.feature, sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum((a.x <> b.x)::INT)::DOUBLE * sum((a.y <> b.y)::INT)::DOUBLE) AS kendall FROM pr a JOIN pr b ON b.right_run = a.right_run AND b.feature = a.feature AND b.rid < a.rid GROUP BY ALL)
  SELECT base.*, kendall FROM base JOIN tau ON tau.right_run = base.right_run AND tau.feature = base.feature"""


@query("i09_lag_profile_stability", with_(A + PROFILE, _PR), "left_annual_share right_annual_share spearman kendall")
def lag_stability(t: Tables):
    from panelwright.operators.agreement import lag_profile_stability, run_pairs
    from panelwright.plans.agreement_queries import RUN_PAIRS

    profile = op.lag_profile(t.attributions, ["run"], ANNUAL)
    return lag_profile_stability(run_pairs(profile, "run", RUN_PAIRS, ["feature", "lag"], ["mean_abs"]), ANNUAL)


@query("i10_site_importance", with_(SHARES, "SELECT s.run, s.site, s.class, s.feature, n_samples, s.mean_abs FROM si s JOIN (SELECT run, site, feature, count(CASE WHEN lag = 1 THEN 1 END) AS n_samples FROM attributions GROUP BY ALL) USING (run, site, feature)"), "mean_abs")
def site_importance(t: Tables):
    return op.site_importance(t.attributions, ["run"], ["site", "class"])


@query("i11_site_group_shares", with_(SHARES, 'SELECT *, (sum(dominant) OVER (PARTITION BY run, site))::BIGINT AS n_tied FROM shares'), "group_abs share")
def group_shares(t: Tables):
    return site_shares(t)


DOMINANT = """, dom AS (SELECT run, site, class, min(feature) AS dominant_feature, max(m) AS dominant_abs, count(*)::INT AS n_tied FROM (SELECT run, site, class, feature, mean_abs, max(mean_abs) OVER (PARTITION BY run, site) AS m FROM si WHERE feature <> 'load') WHERE mean_abs = m GROUP BY ALL)"""


def _dominant(t: Tables):
    return op.dominant_feature(op.site_importance(t.attributions, ["run"], ["site", "class"]), ["run"], ["site", "class"], ["load"])


@query("i12_dominant_nonseasonal", with_(SHARES + DOMINANT, "SELECT * FROM dom"), "dominant_abs")
def dominant(t: Tables):
    return _dominant(t)


CLASSES = """, cls AS (SELECT run, class, "group", count(*) AS n_sites, avg(group_abs) AS mean_abs, sum(dominant)::BIGINT AS dominant_sites FROM shares GROUP BY ALL),
  cs AS (SELECT *, mean_abs / sum(mean_abs) OVER (PARTITION BY run, class) AS share FROM cls)"""


@query("i13_class_summary", with_(SHARES + CLASSES, """SELECT *, row_number() OVER (PARTITION BY run, class ORDER BY mean_abs DESC, "group") = 1 AS class_dominant, dominant_sites::DOUBLE / n_sites AS proportion FROM cs"""), "mean_abs share proportion")
def class_summary(t: Tables):
    return op.class_summary(site_shares(t), ["run"], "class", ENV)


TOP2 = """, rk AS (SELECT *, (rank() OVER w)::INT AS rank, dense_rank() OVER w AS d FROM cs WINDOW w AS (PARTITION BY run, class ORDER BY share DESC)),
  tops AS (SELECT run, class, string_agg(CASE WHEN d = 1 THEN "group" END, ';' ORDER BY "group") AS top1_group, max(CASE WHEN d = 1 THEN share END) AS top1_share, count(CASE WHEN d = 1 THEN 1 END)::INT AS top1_ties,
    string_agg(CASE WHEN d = 2 THEN "group" END, ';' ORDER BY "group") AS top2_group, max(CASE WHEN d = 2 THEN share END) AS top2_share, count(CASE WHEN d = 2 THEN 1 END)::INT AS top2_ties FROM rk GROUP BY ALL),
  top2 AS (SELECT rk.run, rk.class, "group", n_sites, mean_abs, share, rank, top1_group, top1_share, top1_ties, top2_group, top2_share, top2_ties, top1_share - top2_share AS margin FROM rk JOIN tops USING (run, class))"""


@query("i14_class_top2", with_(SHARES + CLASSES + TOP2, "SELECT * FROM top2"), "mean_abs share top1_share top2_share margin")
def class_top2(t: Tables):
    return op.class_top2(site_shares(t), ["run"], "class")


@query("i14_share_matrix", with_(SHARES + CLASSES, "SELECT run, class, " + ", ".join(f"max(CASE WHEN \"group\" = '{g}' THEN share END) AS \"{g}\"" for g in ENV) + " FROM cs GROUP BY ALL"), " ".join(ENV))
def share_matrix(t: Tables):
    return op.share_matrix(op.class_top2(site_shares(t), ["run"], "class"), ["run"], "class", ENV)


BYCLASS = """, recs AS (SELECT run, class, 'predictor' AS record_type, dominant_feature AS name FROM dom UNION ALL SELECT run, class, 'category', CASE dominant_feature WHEN 'energy' THEN 'Solar' WHEN 'water' THEN 'Wet' ELSE 'other' END FROM dom),
  byclass AS (SELECT *, (sum(n_sites_dominant) OVER w)::BIGINT AS n_sites, n_sites_dominant / (sum(n_sites_dominant) OVER w)::DOUBLE AS proportion, n_sites_dominant = max(n_sites_dominant) OVER w AS most_frequent
    FROM (SELECT run, class, record_type, name, count(*) AS n_sites_dominant FROM recs GROUP BY ALL) WINDOW w AS (PARTITION BY run, class, record_type))"""


def _by_class(t: Tables):
    return op.dominant_predictor_by_class(_dominant(t), ["run"], "class", {"energy": "Solar", "water": "Wet"})


@query("i15_dominant_predictor_by_class", with_(SHARES + DOMINANT + BYCLASS, "SELECT * FROM byclass"), "proportion")
def by_class(t: Tables):
    return _by_class(t)


@query("i16_category_stability", with_(SHARES + DOMINANT + BYCLASS, """, wide AS (SELECT class, run, coalesce(max(CASE WHEN name = 'Solar' THEN proportion END), 0) AS Solar, coalesce(max(CASE WHEN name = 'Wet' THEN proportion END), 0) AS Wet FROM byclass WHERE record_type = 'category' GROUP BY ALL),
  tp AS (SELECT class, run, string_agg(name, ';' ORDER BY name) AS top FROM byclass WHERE record_type = 'predictor' AND most_frequent GROUP BY ALL)
  SELECT * FROM (SELECT class, count(*) AS n_runs, min(Solar) AS Solar_min, max(Solar) AS Solar_max, max(Solar) - min(Solar) AS Solar_range, min(Wet) AS Wet_min, max(Wet) AS Wet_max, max(Wet) - min(Wet) AS Wet_range FROM wide GROUP BY class) JOIN
  (SELECT class, count(DISTINCT top) = 1 AS consistent, (SELECT string_agg(u, '|' ORDER BY u) FROM (SELECT DISTINCT unnest(list(tp.top)) AS u)) AS labels FROM tp GROUP BY class) USING (class)"""), "Solar_min Solar_max Solar_range Wet_min Wet_max Wet_range")
def category_stability(t: Tables):
    return op.category_stability(_by_class(t), "run", "class", ["Solar", "Wet"])


@query("i17_filter_attributions", with_(A + ", " + T.INVALID + ", " + T.excluded(WINDOW), "SELECT run, count(*) AS n_cells, count(CASE WHEN lag = 1 AND feature = 'water' THEN 1 END) AS n_samples, sum(abs(shap)) AS total FROM attributions a WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.site = a.site AND e.period = a.period) GROUP BY run"), "total", digits=5)
def filtered(t: Tables):
    """Samples are dropped before they become a row per run, lag and feature, so only samples are shuffled."""
    kept = t.attributions_of(op.filter_attributions(t.samples, exclusion_keys(t.invalid, ["site"], "period", WINDOW), ["site", "period"]))
    return kept.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(F.when((F.col("lag") == 1) & (F.col("feature") == FEATURES[0]), 1)).alias("n_samples"), F.sum(F.abs("shap")).alias("total")
    )


@query("i18_raw_and_grouped", with_(A + IMPORTANCE, """SELECT run, 'variable' AS entity_type, feature AS entity, mean_abs, mean_signed, sign, rank FROM importance UNION ALL SELECT run, 'group', "group", mean_abs, mean_signed, sign, rank FROM gimportance"""), "mean_abs mean_signed rank")
def raw_and_grouped(t: Tables):
    rows = t.attributions
    return op.raw_and_grouped(op.global_importance(rows, ["run"]), op.group_importance(rows, ["run"], GROUPS), ["run"])


@query("i19_cross_check", with_(A + IMPORTANCE, """, stored AS (SELECT run, feature, avg(v) AS mean_abs FROM (SELECT run, feature, site, period, sum(abs(shap)) AS v FROM attributions WHERE period < 1999 * 12 OR feature <> 'peak' GROUP BY ALL) GROUP BY ALL)
  SELECT run, feature, i.mean_abs AS recomputed, s.mean_abs AS stored, round(abs(i.mean_abs - s.mean_abs), 8) AS abs_difference, round(abs(i.mean_abs - s.mean_abs) / abs(s.mean_abs), 8) AS rel_difference, abs(i.mean_abs - s.mean_abs) <= 2e-6 + 2e-6 * abs(s.mean_abs) AS within FROM importance i JOIN stored s USING (run, feature)"""), "recomputed stored abs_difference rel_difference")
def cross_check(t: Tables):
    """Recomputed importances against a per-sample route that misses late samples of one feature."""
    partial = t.nested_attributions.where((F.col("period") < 1999 * 12) | (F.col("feature") != "peak"))
    stored = op.collapse_nested(partial, ["run", "site", "period"], WINDOW).groupBy("run", "feature").agg(F.avg("abs_shap").alias("mean_abs"))
    return op.cross_check(op.global_importance(t.attributions, ["run"]), stored, ["run", "feature"], "mean_abs")


@query("i20_linear_attribution", with_(A, "SELECT run, feature, lag, count(*) AS n, sum(shap) AS total, min(shap) AS low, max(shap) AS high FROM attributions GROUP BY ALL"), "total low high", digits=5)
def linear(t: Tables):
    return t.attributions.groupBy("run", "feature", "lag").agg(F.count(F.lit(1)).alias("n"), F.sum("shap").alias("total"), F.min("shap").alias("low"), F.max("shap").alias("high"))
