"""Time-series operators on the panel."""

from pyspark.sql import functions as F

from panelwright.operators import temporal as op
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.tables import Tables, with_

KEYS, TIME = ["site"], "period"
W = "WINDOW w AS (PARTITION BY site ORDER BY period)"


@query(
    "d01_bounded_ffill",
    with_(T.DENSE, "SELECT site, class, period, " + ", ".join(
        f"coalesce({c}, lag({c}, 1) OVER w, lag({c}, 2) OVER w) AS {c}" for c in ("target", "water")
    ) + f" FROM dense {W}"),
    "target water",
)
def bounded_ffill(t: Tables):
    return op.bounded_ffill(t.dense, KEYS, TIME, ["target", "water"], 2).select("site", "class", "period", "target", "water")


@query("d02_positional_lag", with_(T.DENSE, f"SELECT site, period, lag(heat) OVER w AS heat_lag1, lag(load, 3) OVER w AS load_lag3 FROM dense {W}"), "heat_lag1 load_lag3")
def positional_lag(t: Tables):
    once = op.positional_lag(t.dense, KEYS, TIME, {"heat": "heat_lag1"})
    return op.positional_lag(once, KEYS, TIME, {"load": "load_lag3"}, 3).select("site", "period", "heat_lag1", "load_lag3")


@query(
    "d03_antecedent",
    with_(T.DENSE, f"""SELECT site, period, lag(water, 1) OVER w + lag(water, 2) OVER w + lag(water, 3) OVER w AS water_sum3,
      (lag(energy, 1) OVER w + lag(energy, 2) OVER w + lag(energy, 3) OVER w) / 3 AS energy_mean3 FROM dense {W}"""),
    "water_sum3 energy_mean3",
)
def antecedent(t: Tables):
    out = op.antecedent(t.dense, KEYS, TIME, "water", "water_sum3", 3, "sum")
    return op.antecedent(out, KEYS, TIME, "energy", "energy_mean3", 3, "mean").select("site", "period", "water_sum3", "energy_mean3")


@query(
    "d04_history_windows",
    with_(T.DENSE, """SELECT site, period, target, hw[1] AS oldest_water, hw[12] AS newest_water,
        hw[7] AS water_6_back, list_sum(he) AS energy_12, list_sum(he[7:12]) AS energy_6
      FROM (SELECT site, period, target, count(CASE WHEN water IS NOT NULL AND energy IS NOT NULL THEN 1 END) OVER w12 AS n,
          min(period) OVER w12 AS lo, list(water) OVER w12 AS hw, list(energy) OVER w12 AS he
        FROM dense WINDOW w12 AS (PARTITION BY site ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
      WHERE n = 12 AND period - lo = 12 AND target IS NOT NULL"""),
    "target oldest_water newest_water water_6_back energy_12 energy_6",
)
def history_windows(t: Tables):
    out = op.history_windows(t.dense, KEYS, TIME, ["water", "energy"], "target", [6, 12])

    def total(h: str):
        return F.aggregate(F.transform(h, lambda s: s["energy"]), F.lit(0.0), lambda a, v: a + v)

    return out.select(
        "site", "period", "target", F.col("history_12")[0]["water"].alias("oldest_water"), F.col("history_12")[11]["water"].alias("newest_water"),
        F.col("history_6")[0]["water"].alias("water_6_back"), total("history_12").alias("energy_12"), total("history_6").alias("energy_6"),
    )


@query(
    "d05_assign_sample_id",
    with_(T.DENSE, """SELECT site, period, year, month, row_number() OVER (ORDER BY site, period) - 1 AS sample_id
      FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY period) AS rn FROM dense) WHERE rn > 24"""),
)
def assign_sample_id(t: Tables):
    return op.assign_sample_id(t.dense.select("site", "period", "year", "month"), KEYS, TIME, 24)


@query(
    "d06_affected_by_invalid",
    with_(T.DENSE + ", " + T.INVALID, """SELECT site, period, EXISTS (SELECT 1 FROM invalid i WHERE i.site = d.site AND i.period BETWEEN d.period - 6 AND d.period - 1) AS affected
      FROM dense d"""),
)
def affected_by_invalid(t: Tables):
    return op.affected_by_invalid(t.dense.select("site", "period"), t.invalid, KEYS, TIME, 6)


@query("d07_exclusion_keys", with_(T.PANEL + ", " + T.INVALID + ", " + T.excluded(12), "SELECT site, period, (period // 12)::INT AS year, (period % 12 + 1)::INT AS month FROM excluded"))
def exclusion_keys(t: Tables):
    from panelwright.functions import index_month, index_year

    out = op.exclusion_keys(t.invalid, KEYS, TIME, 12)
    return out.withColumn("year", index_year(TIME)).withColumn("month", index_month(TIME))


@query(
    "d08_filter_domain",
    with_(T.PANEL + ", " + T.INVALID + ", " + T.excluded(12), """SELECT 'clean' AS domain, site, period, target FROM panel p
      WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.site = p.site AND e.period = p.period) UNION ALL SELECT 'full', site, period, target FROM panel"""),
    "target",
)
def filter_domain(t: Tables):
    base = t.panel.select("site", "period", "target")
    frames = [op.filter_domain(base, t.invalid, KEYS, TIME, w).select(F.lit(d).alias("domain"), "*") for d, w in (("clean", 12), ("full", None))]
    return frames[0].unionByName(frames[1])


@query(
    "d09_common_domain",
    with_(T.PANEL + ", " + T.INVALID + ", " + T.excluded(24), """SELECT year, count(*) AS n, count(DISTINCT site) AS sites FROM panel p
      WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE e.site = p.site AND e.period = p.period) GROUP BY year"""),
)
def common_domain(t: Tables):
    kept = op.common_domain(t.panel.select("site", "period", "year"), t.invalid, KEYS, TIME, [6, 12, 24])
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("sites"))


SECTIONS = """, sections AS (SELECT *, (sum(section_start::INT) OVER (PARTITION BY site ORDER BY period))::INT AS section
  FROM (SELECT *, coalesce(period - lag(period) OVER (PARTITION BY site ORDER BY period) > 1, true) AS section_start FROM panel))"""


@query("d10_section_starts", with_(T.PANEL + SECTIONS, "SELECT site, period, section_start, section FROM sections"))
def section_starts(t: Tables):
    return op.section_starts(t.panel.select("site", "period"), KEYS, TIME)


@query(
    "d11_section_summary",
    with_(T.PANEL + SECTIONS, """SELECT sum(l)::BIGINT AS n_records, count(DISTINCT site) AS n_entities, count(*) AS n_sections, min(l) AS section_length_min,
      quantile_cont(l, 0.5)::DOUBLE AS section_length_median, avg(l) AS section_length_mean, max(l) AS section_length_max, count(*) - count(DISTINCT site) AS gap_count
      FROM (SELECT site, section, count(*) AS l FROM sections GROUP BY ALL)"""),
    "section_length_median section_length_mean",
)
def section_summary(t: Tables):
    return op.section_summary(t.panel.select("site", "period"), KEYS, TIME)


GAPS = "SELECT site, previous_period, period AS current_period, period - previous_period AS delta, period - previous_period - 1 AS missing_periods FROM (SELECT site, period, lag(period) OVER (PARTITION BY site ORDER BY period) AS previous_period FROM panel) WHERE period - previous_period > 1"


@query("d12_gap_inventory", with_(T.PANEL, GAPS))
def gap_inventory(t: Tables):
    return op.gap_inventory(t.panel.select("site", "period"), KEYS, TIME)


@query("d12_gap_distribution", with_(T.PANEL, f"SELECT delta, count(*) AS n_gaps, delta - 1 AS missing_periods FROM ({GAPS}) GROUP BY delta"))
def gap_distribution(t: Tables):
    return op.gap_distribution(t.panel.select("site", "period"), KEYS, TIME)


PAIRS = "SELECT * FROM (SELECT site, lag(period) OVER w AS period_before, period, lag(target) OVER w AS value_before, target AS value FROM panel WINDOW w AS (PARTITION BY site ORDER BY period)) WHERE period - period_before = 1 AND value_before IS NOT NULL AND value IS NOT NULL"


@query("d13_consecutive_pairs", with_(T.PANEL, PAIRS), "value_before value")
def consecutive_pairs(t: Tables):
    return op.consecutive_pairs(t.panel.select("site", "period", "target"), KEYS, TIME, "target")


@query(
    "d14_lag1_autocorrelation",
    with_(T.PANEL, f"""SELECT a.rho, a.n_pairs, b.* FROM (SELECT corr(value_before, value) AS rho, count(*) AS n_pairs FROM ({PAIRS})) a,
      (SELECT count(*) AS n_entities, min(k) AS pairs_per_entity_min, quantile_cont(k, 0.5)::DOUBLE AS pairs_per_entity_median, avg(k) AS pairs_per_entity_mean, max(k) AS pairs_per_entity_max
       FROM (SELECT site, count(*) AS k FROM ({PAIRS}) GROUP BY site)) b"""),
    "rho pairs_per_entity_median pairs_per_entity_mean",
)
def lag1_autocorrelation(t: Tables):
    return op.lag1_autocorrelation(t.panel.select("site", "period", "target"), KEYS, TIME, "target")


@query(
    "d15_sequence_acf",
    with_(T.PANEL, " UNION ALL ".join(
        f"SELECT {k} AS lag, corr(b, target) AS correlation, count(*) AS n_pairs FROM (SELECT target, lag(target, {k}) OVER w AS b, period - lag(period, {k}) OVER w AS d FROM panel {W}) WHERE d = {k} AND b IS NOT NULL AND target IS NOT NULL"
        for k in range(1, 13)
    )),
    "correlation",
)
def sequence_acf(t: Tables):
    return op.sequence_acf(t.panel.select("site", "period", "target"), KEYS, TIME, "target", 12)


@query("d16_allocate_days_to_months", with_(T.DAYWEIGHTED, "SELECT site, year, month, dw FROM allocated"), "dw")
def allocate_days_to_months(t: Tables):
    return op.allocate_days_to_months(t.composites, KEYS, "start", "value", "dw")


@query("d16_allocate_event_days", """WITH comp AS (SELECT user_id, (DATE '2024-01-01' + (datediff('day', DATE '2024-01-01', ts::DATE) // 8 * 8)::INT) AS start, sum(round(value * 100)::BIGINT)::DOUBLE / 9973::DOUBLE AS value FROM events GROUP BY ALL),
  starts AS (SELECT start, coalesce(CASE WHEN datediff('day', start, nxt) <= 8 THEN nxt END, start + 8)::DATE AS stop FROM (SELECT start, lead(start) OVER (ORDER BY start) AS nxt FROM (SELECT DISTINCT start FROM comp)))
  SELECT user_id, year(m)::INT AS year, month(m)::INT AS month, sum(value * datediff('day', greatest(start, m::DATE), least(stop, (m + INTERVAL 1 MONTH)::DATE)) / datediff('day', start, stop)) AS dw
  FROM (SELECT user_id, value, s.start, s.stop, unnest(generate_series(date_trunc('month', s.start), date_trunc('month', s.stop - 1), INTERVAL 1 MONTH)) AS m FROM comp c JOIN starts s ON s.start = c.start) GROUP BY ALL""", "dw")
def allocate_event_days(t: Tables):
    origin = F.lit("2024-01-01").cast("date")
    start = F.date_add(origin, (F.floor(F.datediff(F.to_date("ts"), origin) / 8) * 8).cast("int"))
    comp = t.raw("events", "user_id", "ts", "value").groupBy("user_id", start.alias("start")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(9973.0)).alias("value")
    )
    return op.allocate_days_to_months(comp, ["user_id"], "start", "value", "dw")


@query("d17_complete_years", with_(T.PANEL, "SELECT site, year, count(*) AS n_months FROM panel GROUP BY ALL HAVING count(*) = 12 AND count(DISTINCT month) = 12"))
def complete_years(t: Tables):
    return op.complete_years(t.panel.select("site", "year", "month"), KEYS)


ENSEMBLE = """, ensemble AS (SELECT model, site, year, month, max(y_true) AS y_true, avg(y_pred) AS y_pred FROM predictions GROUP BY ALL),
  annual AS (SELECT model, site, year, sum(y_true) AS y_true, sum(y_pred) AS y_pred, sum(y_pred) - sum(y_true) AS residual FROM ensemble GROUP BY ALL HAVING count(y_pred) = 12 AND count(*) = 12 AND count(DISTINCT month) = 12)"""


def _ensemble(t: Tables):
    return t.predictions.groupBy("model", "site", "year", "month").agg(F.max("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))


@query("d18_annual_sums", with_(T.PREDICTIONS + ENSEMBLE, "SELECT * FROM annual"), "y_true y_pred residual")
def annual_sums(t: Tables):
    return op.annual_sums(_ensemble(t), ["model", *KEYS], "y_true", "y_pred")


@query(
    "d18_annual_means",
    with_(T.PREDICTIONS + ENSEMBLE, "SELECT model, year, count(*) AS n_entities, avg(y_true) AS y_true_mean, avg(y_pred) AS y_pred_mean, avg(residual) AS residual_mean FROM annual GROUP BY ALL"),
    "y_true_mean y_pred_mean residual_mean",
)
def annual_means(t: Tables):
    return op.annual_means(op.annual_sums(_ensemble(t), ["model", *KEYS], "y_true", "y_pred"), "y_true", "y_pred", by=["model"])


@query(
    "d19_leave_one_year_out",
    with_(T.PANEL, """SELECT omitted_year, count(*) AS n_rows, sum(section_start::INT)::BIGINT AS n_sections FROM (
      SELECT o.y::INT AS omitted_year, coalesce(period - lag(period) OVER (PARTITION BY o.y, site ORDER BY period) > 1, true) AS section_start
      FROM panel, range(1995, 2002) o(y) WHERE year <> o.y) GROUP BY omitted_year"""),
)
def leave_one_year_out(t: Tables):
    out = op.leave_one_year_out(t.panel.select("site", "period", "year"), KEYS, TIME, list(range(1995, 2002)))
    return out.groupBy("omitted_year").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("section_start").cast("int")).alias("n_sections"))


@query(
    "d20_ordered_decile",
    with_(T.PANEL, "SELECT site, period, load, (floor((row_number() OVER (ORDER BY load, site, period) - 1) * 10 / (SELECT count(*) FROM panel)) + 1)::INT AS decile FROM panel"),
    "load",
)
def ordered_decile(t: Tables):
    return op.ordered_decile(t.panel.select("site", "period", "load"), "load", ["site", "period"])
