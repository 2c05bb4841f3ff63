"""Climatology, ranks, eligibility, support and attrition on the panel."""

from pyspark.sql import functions as F

from panelwright.operators import baselines as op
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.tables import CENTERS, TEST_START, TRAIN_END, Tables, with_

COLS = ["net", "water", "energy", "heat", "load"]


@query("e01_climatology", with_(T.CLIMATOLOGY, "SELECT * FROM clim"), " ".join(f"{c}_mean {c}_median" for c in COLS))
def climatology(t: Tables):
    return t.climatology


@query("e02_anomaly", with_(T.CLIMATOLOGY, f"""SELECT d.site, d.period, d.net - net_mean AS net_anomaly_mean, d.water - water_mean AS water_anomaly_mean, d.net - net_median AS net_anomaly_median
  FROM dense d LEFT JOIN clim c ON c.site = d.site AND c.month = d.month WHERE d.year >= {TEST_START}"""), "net_anomaly_mean water_anomaly_mean net_anomaly_median")
def anomaly(t: Tables):
    ev = t.dense.where(F.col("year") >= TEST_START).select("site", "month", "period", "net", "water")
    out = op.anomaly(ev, t.climatology, ["site", "month"], ["net", "water"])
    return out.select("site", "period", "net_anomaly_mean", "water_anomaly_mean", (F.col("net") - F.col("net_median")).alias("net_anomaly_median"))


@query("e03_midrank_vs_history", with_(T.PANEL, f"""SELECT e.site, e.period,
    CASE WHEN count(h.load) > 0 THEN (count(*) FILTER (WHERE h.load < e.load) + (count(*) FILTER (WHERE h.load = e.load) + 1) * 0.5::DOUBLE) / (count(h.load) + 1) END AS load_rank,
    CASE WHEN count(h.energy) > 0 THEN (count(*) FILTER (WHERE h.energy < e.energy) + (count(*) FILTER (WHERE h.energy = e.energy) + 1) * 0.5::DOUBLE) / (count(h.energy) + 1) END AS energy_rank
  FROM panel e LEFT JOIN panel h ON h.site = e.site AND h.month = e.month AND h.year <= {TRAIN_END} WHERE e.year >= {TEST_START} GROUP BY ALL"""), "load_rank energy_rank")
def midrank(t: Tables):
    ev = t.panel.where(F.col("year") >= TEST_START).select("site", "month", "period", "load", "energy")
    hist = t.panel.where(F.col("year") <= TRAIN_END).select("site", "month", "load", "energy")
    return op.midrank_vs_history(ev, hist, ["site", "month"], ["load", "energy"]).select("site", "period", "load_rank", "energy_rank")


@query("e04_historically_active", with_(T.CLIMATOLOGY, """SELECT d.site, d.period, coalesce(c.net_median > 0, false) AS active FROM dense d LEFT JOIN clim c ON c.site = d.site AND c.month = d.month"""))
def active(t: Tables):
    out = t.dense.select("site", "month", "period").join(t.climatology.select("site", "month", "net_median"), ["site", "month"], "left")
    return out.select("site", "period", op.historically_active("net_median").alias("active"))


def _predicted(t: Tables, keys):
    train = t.panel.where(F.col("year") <= TRAIN_END)
    test = t.panel.where(F.col("year") >= TEST_START).select("site", "month", "period", "target")
    return op.climatology_predict(test, train, keys, "target", calendar=keys == ["month"]).select("site", "period", "target", "y_pred")


@query("e05_monthly_climatology_predict", with_(T.PANEL, f"""SELECT site, period, target, y_pred FROM panel p LEFT JOIN (SELECT month, avg(target) AS y_pred FROM panel WHERE year <= {TRAIN_END} GROUP BY month) c ON c.month = p.month
  WHERE year >= {TEST_START}"""), "target y_pred")
def monthly_climatology(t: Tables):
    return _predicted(t, ["month"])


@query("e06_point_month_climatology_predict", with_(T.PANEL, f"""SELECT p.site, period, target, y_pred FROM panel p LEFT JOIN (SELECT site, month, avg(target) AS y_pred FROM panel WHERE year <= {TRAIN_END} GROUP BY ALL) c
  ON c.site = p.site AND c.month = p.month WHERE year >= {TEST_START}"""), "target y_pred")
def point_month_climatology(t: Tables):
    return _predicted(t, ["site", "month"])


@query("e07_complete_case", with_(T.DENSE, """SELECT year, count(*) AS n, count(CASE WHEN net IS NOT NULL AND prev_heat IS NOT NULL AND peak IS NOT NULL THEN 1 END) AS n_complete
  FROM (SELECT *, lag(heat) OVER (PARTITION BY site ORDER BY period) AS prev_heat FROM dense) GROUP BY year"""))
def complete_case(t: Tables):
    from panelwright.operators.temporal import positional_lag

    rows = positional_lag(t.dense, ["site"], "period", {"heat": "prev_heat"})
    ok = op.complete_case(["net", "prev_heat", "peak"])
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_complete"))


FLAGS = ["eligible_primary", "eligible_all12", "domain_season", "eligible_season", "eligible_median_response", "eligible_raw_exposure", "eligible_qa1", "eligible_qa2", "eligible_dayweighted", "eligible_cold_snow"]


@query("e08_eligibility_flags", with_(T.FLAGGED, "SELECT site, period, " + ", ".join(FLAGS) + " FROM flagged"))
def eligibility(t: Tables):
    return t.flagged.select("site", "period", *FLAGS)


@query("e08_analysis_master", with_(T.MASTER, "SELECT * FROM master"), T.MASTER_DOUBLES)
def analysis_master(t: Tables):
    return t.master


@query("e09_monthly_qa", with_(T.COMPOSITES + ", " + T.MONTHLY_QA, "SELECT *, (good_fraction >= 0.75)::INT AS qa1, (good_fraction >= 1.0)::INT AS qa2 FROM monthly_qa"), "good_fraction")
def monthly_qa(t: Tables):
    return t.monthly_qa


@query("e10_snow_state", with_(T.DENSE + ", " + T.COMPOSITES + ", " + T.SNOW, """SELECT d.site, d.period, (any_flag IS NOT NULL)::INT AS snow_known, any_flag AS snow
  FROM dense d LEFT JOIN snow s ON s.site = d.site AND s.year = d.year AND s.month = d.month"""))
def snow_state(t: Tables):
    joined = t.dense.select("site", "period", "year", "month").join(t.snow, ["site", "year", "month"], "left")
    return op.snow_state(joined, "any_flag", "record_count").select("site", "period", "snow_known", "snow")


@query("e11_dayweighted_target", with_(T.DAYWEIGHTED, "SELECT site, year, month, dw, dw_mean, dw_median, dw_anomaly_mean, dayweighted_active FROM dayweighted"), "dw dw_mean dw_median dw_anomaly_mean", digits=9)
def dayweighted(t: Tables):
    return t.dayweighted


POOL = f""", pool AS (SELECT d.site, d.year, d.month, d.water - water_mean AS water_anomaly_mean, d.energy - energy_mean AS energy_anomaly_mean
  FROM dense d JOIN clim c ON c.site = d.site AND c.month = d.month WHERE d.year <= {TRAIN_END} AND net_median > 0 AND d.water IS NOT NULL AND d.energy IS NOT NULL)"""


def _pool(t: Tables):
    return op.pooled_anomaly_pool(t.dense, t.climatology, ["site", "month"], ["water", "energy"], "net_median", 0, TRAIN_END)


@query("e12_pooled_anomaly_pool", with_(T.CLIMATOLOGY + POOL, "SELECT * FROM pool"), "water_anomaly_mean energy_anomaly_mean")
def pooled(t: Tables):
    return _pool(t).select("site", "year", "month", "water_anomaly_mean", "energy_anomaly_mean")


@query("e13_quantile_type1", with_(T.CLIMATOLOGY + POOL, """SELECT 'p_wet' AS name, 'water_anomaly_mean' AS field, 0.75::DOUBLE AS probability, quantile_disc(water_anomaly_mean, 0.75) AS value FROM pool
  UNION ALL SELECT 'r_dim', 'energy_anomaly_mean', 0.25, quantile_disc(energy_anomaly_mean, 0.25) FROM pool UNION ALL SELECT 'r_mid', 'energy_anomaly_mean', 0.5, quantile_disc(energy_anomaly_mean, 0.5) FROM pool"""), "probability value")
def quantile_type1(t: Tables):
    return op.quantile_type1(_pool(t), {"p_wet": ("water_anomaly_mean", 0.75), "r_dim": ("energy_anomaly_mean", 0.25), "r_mid": ("energy_anomaly_mean", 0.5)})


@query("e14_empirical_rank", with_(T.PANEL, f"""SELECT site, period, load, (less + ties * 0.5::DOUBLE + 0.5::DOUBLE) / (n + 1) AS load_rank FROM panel e JOIN
  (SELECT x, (SELECT count(*) FROM panel h WHERE h.year <= {TRAIN_END} AND h.load < x) AS less, (SELECT count(*) FROM panel h WHERE h.year <= {TRAIN_END} AND h.load = x) AS ties,
     (SELECT count(*) FROM panel h WHERE h.year <= {TRAIN_END}) AS n FROM (SELECT DISTINCT load AS x FROM panel)) r ON r.x = e.load WHERE year >= {TEST_START}"""), "load load_rank")
def empirical_rank(t: Tables):
    ev = t.panel.where(F.col("year") >= TEST_START).select("site", "period", "load")
    pool = t.panel.where(F.col("year") <= TRAIN_END).select("load")
    return op.empirical_rank(ev, "load", pool, "load", "load_rank")


NEAR = "sqrt((water_rank - {x}) * (water_rank - {x}) + (energy_rank - {y}) * (energy_rank - {y})) <= 0.1"


@query("e15_support_counts", with_(T.FLAGGED, """SELECT *, CASE WHEN n_records >= 100 AND n_sites >= 50 AND n_years >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT point, x_target, y_target, count(CASE WHEN near THEN 1 END) AS n_records, count(DISTINCT CASE WHEN near THEN site END) AS n_sites, count(DISTINCT CASE WHEN near THEN year END) AS n_years
  FROM (SELECT *, """ + NEAR.format(x="x_target", y="y_target") + """ AS near FROM flagged, (VALUES ('A', 0.75::DOUBLE, 0.25::DOUBLE), ('B', 0.75::DOUBLE, 0.5::DOUBLE)) c(point, x_target, y_target) WHERE eligible_primary = 1) GROUP BY ALL)"""), "x_target y_target")
def support(t: Tables):
    primary = t.flagged.where(F.col("eligible_primary") == 1)
    return op.support_counts(primary, "water_rank", "energy_rank", CENTERS, "site", minimum=(100, 50, 2))


@query("e16_support_by_class", with_(T.FLAGGED, "SELECT class, " + ", ".join(
    f"count(CASE WHEN {n} THEN 1 END) AS {p}_records, count(DISTINCT CASE WHEN {n} THEN site END) AS {p}_sites, count(DISTINCT CASE WHEN {n} THEN year END) AS {p}_years"
    for p, n in (("A", NEAR.format(x="0.75::DOUBLE", y="0.25::DOUBLE")), ("B", NEAR.format(x="0.75::DOUBLE", y="0.5::DOUBLE")))
) + ", CASE WHEN A_records >= 10 AND A_sites >= 5 AND A_years >= 2 AND B_records >= 10 AND B_sites >= 5 AND B_years >= 2 THEN 'QUALIFIED' ELSE 'NOT_ESTIMABLE' END AS status FROM flagged WHERE eligible_primary = 1 GROUP BY class"))
def support_by_class(t: Tables):
    primary = t.flagged.where(F.col("eligible_primary") == 1)
    return op.support_by_class(primary, "water_rank", "energy_rank", CENTERS, "class", "site", minimum=(10, 5, 2))


@query("e17_support_attrition",  "WITH " + T.FLAGGED + """, counts AS (SELECT point, domain, count(CASE WHEN near AND inside THEN 1 END) AS records, count(DISTINCT CASE WHEN near AND inside THEN site END) AS sites,
    count(DISTINCT CASE WHEN near AND inside THEN year END) AS years
  FROM (SELECT site, year, point, domain, """ + NEAR.format(x="x", y="y") + """ AS near,
    CASE domain WHEN 'primary' THEN eligible_primary = 1 WHEN 'qa1' THEN eligible_qa1 = 1 ELSE eligible_qa2 = 1 END AS inside
    FROM flagged, (VALUES ('A', 0.75::DOUBLE, 0.25::DOUBLE), ('B', 0.75::DOUBLE, 0.5::DOUBLE)) p(point, x, y), (VALUES ('primary'), ('qa1'), ('qa2')) d(domain)) GROUP BY ALL)
  SELECT c.point, c.domain, c.records, c.sites, c.years, c.records::DOUBLE / nullif(b.records, 0) AS retention FROM counts c JOIN counts b ON b.point = c.point AND b.domain = 'primary'""", "retention")
def support_attrition(t: Tables):
    domains = {"primary": F.col("eligible_primary") == 1, "qa1": F.col("eligible_qa1") == 1, "qa2": F.col("eligible_qa2") == 1}
    return op.support_attrition(t.flagged, "water_rank", "energy_rank", CENTERS, domains, "primary", "site")


QUART = "CASE WHEN {c} <= 0.25 THEN 'Q1_[0,0.25]' WHEN {c} <= 0.5 THEN 'Q2_(0.25,0.50]' WHEN {c} <= 0.75 THEN 'Q3_(0.50,0.75]' WHEN {c} IS NOT NULL THEN 'Q4_(0.75,1]' END"


@query("e18_attrition_by_stratum", "WITH " + T.FLAGGED + ", strata AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS stratum_type, {v} AS stratum_value, eligible_qa1 AS qa1, eligible_qa2 AS qa2 FROM flagged WHERE eligible_primary = 1"
    for n, v in (("water_rank_quartile", QUART.format(c="water_rank")), ("energy_rank_quartile", QUART.format(c="energy_rank")), ("year", "year::VARCHAR"), ("month", "month::VARCHAR"))
) + ") SELECT stratum_type, stratum_value, count(*) AS n, sum(qa1)::BIGINT AS n_qa1, avg(qa1) AS qa1_fraction, sum(qa2)::BIGINT AS n_qa2, avg(qa2) AS qa2_fraction FROM strata WHERE stratum_value IS NOT NULL GROUP BY ALL", "qa1_fraction qa2_fraction")
def attrition_by_stratum(t: Tables):
    primary = t.flagged.where(F.col("eligible_primary") == 1)
    flags = {"qa1": F.col("eligible_qa1") == 1, "qa2": F.col("eligible_qa2") == 1}
    return op.attrition_by_stratum(primary, flags, {"water_rank_quartile": "water_rank", "energy_rank_quartile": "energy_rank"}, ["year", "month"])


@query("e19_attrition_by_reason", "WITH " + T.FLAGGED + """, tagged AS (SELECT CASE WHEN cold + unknown + present + few > 1 THEN 'multiple' WHEN cold = 1 THEN 'cold' WHEN unknown = 1 THEN 'snow_unknown' WHEN present = 1 THEN 'snow_present'
    WHEN few = 1 THEN 'few_lines' ELSE 'retained' END AS reason
  FROM (SELECT coalesce(heat < 0.4, false)::INT AS cold, coalesce(snow_known, 0) * -1 + 1 AS unknown, coalesce(snow = 1, false)::INT AS present, coalesce(load <= 3, false)::INT AS few FROM flagged WHERE eligible_primary = 1))
  SELECT l.reason, count(t.reason) AS n_records, count(t.reason)::DOUBLE / (SELECT count(*) FROM tagged) AS fraction
  FROM (VALUES ('retained'), ('cold'), ('snow_unknown'), ('snow_present'), ('few_lines'), ('multiple')) l(reason) LEFT JOIN tagged t ON t.reason = l.reason GROUP BY l.reason""", "fraction")
def attrition_by_reason(t: Tables):
    primary = t.flagged.where(F.col("eligible_primary") == 1)
    reasons = {
        "cold": F.col("heat") < 0.4, "snow_unknown": F.coalesce(F.col("snow_known"), F.lit(0)) == 0, "snow_present": F.col("snow") == 1, "few_lines": F.col("load") <= 3,
    }
    return op.attrition_by_reason(primary, reasons)


DOMAINS = {"primary": "eligible_primary", "all12": "eligible_all12", "season": "eligible_season", "dayweighted": "eligible_dayweighted", "cold_snow": "eligible_cold_snow"}
_STACK = ", stacked AS (" + " UNION ALL ".join(f"SELECT '{k}' AS domain, {v} = 1 AS i, eligible_primary = 1 AS r, site, year, month, active FROM flagged" for k, v in DOMAINS.items()) + ")"


@query("e20_domain_composition", "WITH " + T.FLAGGED + _STACK + """ SELECT domain, count(CASE WHEN i THEN 1 END) AS n_records, count(DISTINCT CASE WHEN i THEN site END) AS n_sites, count(DISTINCT CASE WHEN i THEN year END) AS n_years,
  count(DISTINCT CASE WHEN i THEN month END) AS n_months, avg(CASE WHEN i THEN active END) AS active_share, count(CASE WHEN i AND r THEN 1 END) AS "both", count(CASE WHEN i AND NOT r THEN 1 END) AS domain_only,
  count(CASE WHEN NOT i AND r THEN 1 END) AS reference_only FROM stacked GROUP BY domain""", "active_share")
def domain_composition(t: Tables):
    return op.domain_composition(t.flagged, {k: F.col(v) == 1 for k, v in DOMAINS.items()}, "primary", F.col("active") == 1, "site")


@query("e21_sample_summary", "WITH " + T.FLAGGED + _STACK + """ SELECT domain, count(CASE WHEN i THEN 1 END) AS n_records, count(DISTINCT CASE WHEN i THEN site END) AS n_sites, count(DISTINCT CASE WHEN i THEN year END) AS n_years,
  count(CASE WHEN i THEN 1 END)::DOUBLE / nullif(count(CASE WHEN r THEN 1 END), 0) AS retention FROM stacked GROUP BY domain""", "retention")
def sample_summary(t: Tables):
    return op.sample_summary(t.flagged, {k: F.col(v) == 1 for k, v in DOMAINS.items()}, "primary", "site")


@query("e22_excluded_by_year", with_(T.PANEL + ", " + T.INVALID + ", " + T.excluded(12), """SELECT year, count(CASE WHEN x THEN 1 END) AS n_excluded, count(CASE WHEN NOT x THEN 1 END) AS n_kept, count(DISTINCT CASE WHEN NOT x THEN site END) AS sites_kept
  FROM (SELECT p.year, p.site, EXISTS (SELECT 1 FROM excluded e WHERE e.site = p.site AND e.period = p.period) AS x FROM panel p) GROUP BY year"""))
def excluded_by_year(t: Tables):
    from panelwright.operators.temporal import affected_by_invalid

    marked = affected_by_invalid(t.panel.select("site", "period", "year"), t.invalid, ["site"], "period", 12)
    return op.excluded_by_year(marked, F.col("affected"), "site")
