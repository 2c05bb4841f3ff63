"""Scalar expressions and derived columns."""

import math

from pyspark.sql import functions as F

from panelwright import functions as fn
from panelwright.functions.scalar import FAILURE_PATTERNS
from panelwright.operators import scaling
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.tables import FEATURES, TRAIN_END, WINDOW, Tables, with_

ORDER_YM = "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders"


def _orders(t: Tables):
    return t.raw("orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query("c01_month_index", f"SELECT o_orderkey, (y * 12 + m - 1)::INT AS idx, ((y * 12 + m - 1 - 5) // 12)::INT AS year_before, ((y * 12 + m - 1 - 5) % 12 + 1)::INT AS month_before FROM ({ORDER_YM})")
def month_index(t: Tables):
    y, m = fn.add_months("y", "m", -5)
    return _orders(t).select("o_orderkey", fn.month_index("y", "m").alias("idx"), y.alias("year_before"), m.alias("month_before"))


@query("c02_cyclic_month", f"SELECT o_orderkey, sin(m * {2 * math.pi / 12!r}::DOUBLE) AS month_sin, cos(m * {2 * math.pi / 12!r}::DOUBLE) AS month_cos FROM ({ORDER_YM})", "month_sin month_cos")
def cyclic_month(t: Tables):
    s, c = fn.cyclic_month("m")
    return _orders(t).select("o_orderkey", s.alias("month_sin"), c.alias("month_cos"))


@query("c03_circular_angle", "SELECT l_orderkey, l_linenumber, sin(radians(l_quantity * 7)) AS aspect_sin, cos(radians(l_quantity * 7)) AS aspect_cos FROM lineitem", "aspect_sin aspect_cos")
def circular_angle(t: Tables):
    s, c = fn.circular_angle(F.col("l_quantity") * 7)
    return t.raw("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", s.alias("aspect_sin"), c.alias("aspect_cos"))


@query("c04_one_hot", with_(T.SITES, "SELECT site, class, " + ", ".join(f"(class = {k})::INT::DOUBLE AS class_{k}" for k in range(4)) + " FROM sites"), " ".join(f"class_{k}" for k in range(4)))
def one_hot(t: Tables):
    return fn.one_hot(t.sites, "class", {k: f"class_{k}" for k in range(4)})


@query("c05_assign_split", with_(T.PANEL, f"SELECT site, period, CASE WHEN year <= {TRAIN_END} THEN 'train' WHEN year <= 1999 THEN 'val' ELSE 'test' END AS split FROM panel"))
def assign_split(t: Tables):
    return t.panel.select("site", "period", fn.assign_split("year", TRAIN_END, 1999).alias("split"))


@query("c06_unit_scale", "SELECT l_orderkey, l_linenumber, l_quantity * 1000.0::DOUBLE AS grams, l_quantity * 0.02::DOUBLE + -273.15::DOUBLE AS celsius FROM lineitem", "grams celsius")
def unit_scale(t: Tables):
    return t.raw("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(
        "l_orderkey", "l_linenumber", fn.unit_scale("l_quantity", 1000).alias("grams"), fn.unit_scale("l_quantity", 0.02, -273.15).alias("celsius")
    )


@query("c07_vpd", "SELECT l_orderkey, l_linenumber, greatest(0.611 * exp(17.27 * t / (t + 237.3)) - 0.611 * exp(17.27 * d / (d + 237.3)), 0.0) AS vpd FROM (SELECT l_orderkey, l_linenumber, l_quantity - 10 AS t, l_discount * 300 AS d FROM lineitem)", "vpd")
def vpd(t: Tables):
    rows = t.raw("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rows.select("l_orderkey", "l_linenumber", fn.vapour_pressure_deficit(F.col("l_quantity") - 10, F.col("l_discount") * 300).alias("vpd"))


def _weighted(t: Tables):
    """Panel with the number of training histories that contain each cell."""
    keys = t.samples.where(F.col("year") <= TRAIN_END).select("site", "period", F.lit(True).alias("in_train"))
    rows = t.panel.join(keys, ["site", "period"], "left").withColumn("fold", F.pmod("site", F.lit(5)).cast("int"))
    return scaling.coverage_weight(rows, ["site"], "period", F.col("in_train"), WINDOW)


CENTER = {"load": 7.0, "peak": 40.0}


@query("c08_standardise_fit", with_(T.FEATURES_LONG, f"SELECT feature, count(*)::DOUBLE AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM features_long WHERE year <= {TRAIN_END} GROUP BY feature"), "n mean sd")
def standardise_fit(t: Tables):
    return scaling.standardise_fit(_weighted(t), FEATURES, "weight", CENTER)


SCALER = f", scaler AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM features_long WHERE year <= {TRAIN_END} GROUP BY feature)"


@query("c09_standardise_apply", with_(T.FEATURES_LONG + SCALER, "SELECT p.site, p.period, (p.water - w.mean) / w.sd AS water_scaled, (p.load - l.mean) / l.sd AS load_scaled, (p.water - w.mean) / w.sd * w.sd + w.mean AS water_back FROM panel p, (SELECT * FROM scaler WHERE feature = 'water') w, (SELECT * FROM scaler WHERE feature = 'load') l"), "water_scaled load_scaled water_back")
def standardise_apply(t: Tables):
    scaler = scaling.standardise_fit(_weighted(t), FEATURES, "weight", CENTER)
    out = scaling.standardise_apply(t.panel.select("site", "period", "water", "load"), scaler, ["water", "load"])
    back = {c: scaler.where(F.col("feature") == "water").select(c).scalar() for c in ("mean", "sd")}
    return out.select("site", "period", "water_scaled", "load_scaled", scaling.standardise_invert(F.col("water_scaled"), back["mean"], back["sd"], 1.0).alias("water_back"))


@query("c10_fold_scaler", with_(T.FEATURES_LONG, f"SELECT h.f::INT AS held_out, feature, count(*)::DOUBLE AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM features_long, range(5) h(f) WHERE year <= {TRAIN_END} AND site % 5 <> h.f GROUP BY ALL"), "n mean sd")
def fold_scaler(t: Tables):
    return scaling.fold_scaler(_weighted(t), "fold", list(range(5)), FEATURES, "weight", CENTER)


@query("c11_residual", with_(T.PREDICTIONS, "SELECT model, seed, site, period, y_pred - y_true AS residual FROM predictions"), "residual")
def residual(t: Tables):
    return t.predictions.select("model", "seed", "site", "period", fn.residual("y_pred", "y_true").alias("residual"))


@query("c12_sign_tol", with_(T.PANEL, "SELECT site, period, CASE WHEN d > 1e-12 THEN 1 WHEN d < -1e-12 THEN -1 ELSE 0 END AS sign, CASE WHEN d > 1e-12 THEN 'positive mean attribution' WHEN d < -1e-12 THEN 'negative mean attribution' ELSE 'near-zero mean attribution' END AS direction FROM (SELECT site, period, load - 7 AS d FROM panel)"))
def sign_tol(t: Tables):
    d = F.col("load") - 7
    return t.panel.select("site", "period", fn.sign_tol(d).alias("sign"), fn.direction_text(d).alias("direction"))


@query("c13_classify", with_(T.PANEL, "SELECT site, period, CASE WHEN load > 10 THEN 'HIGH' WHEN load >= 5 THEN 'CAUTION' ELSE 'ROUTINE' END AS level, CASE WHEN abs(net) < 0.25 AND water < 2 AND heat < 0.5 THEN 'limited' WHEN abs(net) < 0.5 AND water < 3 AND heat < 0.6 THEN 'moderate' ELSE 'pronounced' END AS shift FROM panel"))
def classify(t: Tables):
    # the shift measures are scaled so that the fixed limits fall inside the panel's range
    shift = fn.shift_class("net", F.when(F.col("water") < 2, 0.2).when(F.col("water") < 3, 0.4).otherwise(0.9), F.when(F.col("heat") < 0.5, 0.04).when(F.col("heat") < 0.6, 0.09).otherwise(0.2))
    return t.panel.select("site", "period", fn.classify("load", [(">", 10, "HIGH"), (">=", 5, "CAUTION")], "ROUTINE").alias("level"), shift.alias("shift"))


@query("c14_rank_quartile_bin", "WITH " + T.MASTER + " SELECT site, period, CASE WHEN water_rank <= 0.25 THEN 'Q1_[0,0.25]' WHEN water_rank <= 0.5 THEN 'Q2_(0.25,0.50]' WHEN water_rank <= 0.75 THEN 'Q3_(0.50,0.75]' WHEN water_rank IS NOT NULL THEN 'Q4_(0.75,1]' END AS bin FROM master")
def rank_bin(t: Tables):
    return t.master.select("site", "period", fn.rank_quartile_bin("water_rank").alias("bin"))


@query("c15_decision_label", with_(T.PANEL, """SELECT site, period, CASE WHEN a = 'QA2' THEN 'QA2_' || CASE WHEN NOT s THEN 'COVERAGE_LIMITED_FIXED_CONTRAST_UNSUPPORTED' WHEN c > 0 THEN 'SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED'
      WHEN hi < 0 THEN 'DIRECTION_AND_INTERVAL_CONSISTENT' ELSE 'DIRECTIONALLY_CONSISTENT_COVERAGE_LIMITED' END
    ELSE 'QA1_' || CASE WHEN NOT s THEN 'SUPPORT_FAIL' WHEN stop THEN 'DIAGNOSTIC_STOP' WHEN c >= 0 THEN 'DIRECTION_FAIL' WHEN hi >= 0 THEN 'CI_CROSSES_ZERO' ELSE 'ROBUSTNESS_PASS' END END AS decision
  FROM (SELECT site, period, CASE WHEN month % 2 = 0 THEN 'QA2' ELSE 'QA1' END AS a, net AS c, net + water / 4 AS hi, load >= 4 AS s, peak >= 50 AS stop FROM panel)"""))
def decision(t: Tables):
    label = fn.decision_label(
        F.when(F.pmod("month", F.lit(2)) == 0, "QA2").otherwise("QA1"), "net", F.col("net") + F.col("water") / 4, F.col("load") >= 4, F.col("peak") >= 50
    )
    return t.panel.select("site", "period", label.alias("decision"))


@query("c15_domain_label", with_(T.PANEL, """SELECT site, period, CASE WHEN NOT s THEN 'DOMAIN_SENSITIVITY_FIXED_CONTRAST_UNSUPPORTED' WHEN stop THEN 'DOMAIN_SENSITIVITY_DIAGNOSTIC_STOP'
    WHEN a = 'FULL_YEAR' THEN CASE WHEN c > 0 THEN 'FULL_YEAR_SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED' WHEN hi < 0 THEN 'FULL_YEAR_DIRECTION_AND_INTERVAL_CONSISTENT' ELSE 'FULL_YEAR_DIRECTIONALLY_CONSISTENT_BUT_IMPRECISE' END
    WHEN c > 0 THEN 'APR_SEP_SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED' WHEN hi < 0 THEN 'APR_SEP_ROBUSTNESS_PASS' ELSE 'APR_SEP_DIRECTIONALLY_CONSISTENT_BUT_IMPRECISE' END AS decision
  FROM (SELECT site, period, CASE WHEN month BETWEEN 4 AND 9 THEN 'APR_SEP' ELSE 'FULL_YEAR' END AS a, net AS c, net + water / 4 AS hi, load >= 4 AS s, peak >= 50 AS stop FROM panel)"""))
def domain_decision(t: Tables):
    label = fn.domain_label(F.when(F.col("month").between(4, 9), "APR_SEP").otherwise("FULL_YEAR"), "net", F.col("net") + F.col("water") / 4, F.col("load") >= 4, F.col("peak") >= 50)
    return t.panel.select("site", "period", label.alias("decision"))


@query("c15_adjustment_label", with_(T.PANEL, """SELECT site, period, upper(a) || '_' || CASE WHEN stop THEN 'DIAGNOSTIC_STOP' WHEN NOT s THEN 'FIXED_CONTRAST_UNSUPPORTED' WHEN c > 0 THEN 'SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED' WHEN c = 0 THEN 'ZERO_CONTRAST_ANALYSIS_CHECK_REQUIRED'
    WHEN hi >= 0 THEN 'DIRECTIONALLY_CONSISTENT_BUT_IMPRECISE' WHEN a = 'Model2' THEN 'ADJUSTMENT_ROBUSTNESS_PASS' ELSE 'HIGH_ADJUSTMENT_DIRECTION_AND_INTERVAL_CONSISTENT' END AS decision
  FROM (SELECT site, period, CASE WHEN month % 2 = 0 THEN 'Model2' ELSE 'model3' END AS a, CASE WHEN abs(net) < 0.2 THEN 0 ELSE net END AS c, net + water / 4 AS hi, load >= 4 AS s, peak >= 50 AS stop FROM panel)"""))
def adjustment_decision(t: Tables):
    contrast = F.when(F.abs("net") < 0.2, 0.0).otherwise(F.col("net"))
    label = fn.adjustment_label(F.when(F.pmod("month", F.lit(2)) == 0, "Model2").otherwise("model3"), contrast, F.col("net") + F.col("water") / 4, F.col("load") >= 4, F.col("peak") >= 50)
    return t.panel.select("site", "period", label.alias("decision"))


_CATEGORY = " ".join(f"WHEN regexp_matches(m, '{pattern}') THEN '{name}'" for name, pattern in FAILURE_PATTERNS)


@query("c16_classify_message", f"SELECT turn, conv_id, role, CASE WHEN m = '' THEN 'NONE' {_CATEGORY} ELSE 'FIT_ERROR' END AS category FROM (SELECT *, lower(coalesce(text, '')) AS m FROM conversations)")
def message(t: Tables):
    return t.raw("conversations", "turn", "conv_id", "role", "text").select("turn", "conv_id", "role", fn.classify_message("text").alias("category"))


@query("c16_classify_url", f"SELECT page_id, CASE WHEN m = '' THEN 'NONE' {_CATEGORY} ELSE 'FIT_ERROR' END AS category FROM (SELECT *, lower(coalesce(url, '')) AS m FROM pages)")
def url_message(t: Tables):
    return t.raw("pages", "page_id", "url").select("page_id", fn.classify_message("url").alias("category"))


@query("c17_join_sorted", with_(T.PANEL, "SELECT site, year, string_agg(m, ';' ORDER BY m) AS months FROM (SELECT DISTINCT site, year, lpad(month::VARCHAR, 2, '0') AS m FROM panel) GROUP BY ALL"))
def join_sorted(t: Tables):
    return t.panel.groupBy("site", "year").agg(fn.join_sorted(F.lpad(F.col("month").cast("string"), 2, "0")).alias("months"))


@query("c18_month_label", f"SELECT o_orderkey, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][m] AS label FROM ({ORDER_YM})")
def month_label(t: Tables):
    return _orders(t).select("o_orderkey", fn.month_label("m").alias("label"))


@query("c19_composite_key", with_(T.PANEL, "SELECT site || '|' || year || '|' || month AS key, target FROM panel"), "target")
def composite_key(t: Tables):
    return t.panel.select(fn.composite_key("site", "year", "month").alias("key"), "target")


@query("c20_flag_true", "WITH " + T.FLAGGED + " SELECT site, period, coalesce(dw_active = 1, false) AS dw, coalesce(snow = 1, false) AS snowy FROM flagged")
def flag_true(t: Tables):
    return t.flagged.select("site", "period", fn.flag_true("dw_active").alias("dw"), fn.flag_true("snow").alias("snowy"))


@query("c21_null_safe_equal", "WITH " + T.MASTER + " SELECT site, period, (net_mean IS NOT DISTINCT FROM net_median OR coalesce(abs(net_mean - net_median) <= 0.1, false)) AS same FROM master")
def null_safe_equal(t: Tables):
    return t.master.select("site", "period", fn.null_safe_equal("net_mean", "net_median", 0.1).alias("same"))
