"""Expectations on the raw tables and the panel; each query reports real violations of the data."""

from pyspark.sql import functions as F

from panelwright.operators import checks as op
from panelwright.operators import rule_suite as suite
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.tables import DRAWS, TRAIN_END, Tables, with_

OE = "observed expected"


def viol(check: str, key: str, observed: str, expected: str, rest: str) -> str:
    return f"SELECT '{check}' AS \"check\", {key} AS key, ({observed})::DOUBLE AS observed, ({expected})::DOUBLE AS expected {rest}"


@query("b01_expect_unique", viol("unique", "l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR", "count(*)", "1", "FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"), OE)
def unique(t: Tables):
    return op.expect_unique(t.raw("lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("b02_expect_finite", with_(T.DENSE, " UNION ALL ".join(f"SELECT 'finite' AS \"check\", '{c}' AS key, n AS observed, 0::DOUBLE AS expected FROM (SELECT count(CASE WHEN {c} IS NULL THEN 1 END)::DOUBLE AS n FROM dense) WHERE n > 0" for c in ("target", "water", "period"))), OE)
def finite(t: Tables):
    return op.expect_finite(t.dense, ["target", "water", "period"])


@query("b03_expect_integer_keys", """SELECT 'integer_keys' AS "check", key, observed, 0::DOUBLE AS expected FROM (
  SELECT 'user_id' AS key, count(CASE WHEN user_id IS NULL THEN 1 END)::DOUBLE AS observed FROM events UNION ALL
  SELECT 'value', count(CASE WHEN value IS NULL OR value <> floor(value) THEN 1 END) FROM events UNION ALL
  SELECT 'slot', count(CASE WHEN (user_id % 15) NOT BETWEEN 1 AND 12 THEN 1 END) FROM events) WHERE observed > 0""", OE)
def integer_keys(t: Tables):
    rows = t.raw("events", "user_id", "value").withColumn("slot", F.pmod("user_id", F.lit(15)))
    return op.expect_integer_keys(rows, ["user_id", "value"], "slot")


@query("b04_expect_complete_history", with_(T.PANEL, viol("complete_history", "site::VARCHAR", "count(DISTINCT period)", "83", "FROM panel GROUP BY site HAVING count(*) <> 83 OR count(DISTINCT period) <> 83 OR max(period) - min(period) + 1 <> 83")), OE)
def complete_history(t: Tables):
    return op.expect_complete_history(t.panel.select("site", "period"), ["site"], "period", 83)


@query("b05_expect_domain", viol("domain", "event_type", "count(*)", "0", "FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view') GROUP BY event_type"), OE)
def domain(t: Tables):
    return op.expect_domain(t.raw("events", "event_type"), "event_type", ["click", "view"])


@query("b06_expect_counts", with_(T.PANEL, """SELECT 'counts' AS "check", split || '|' || what AS key, o::DOUBLE AS observed, e::DOUBLE AS expected FROM (
  SELECT split, 'rows' AS what, count(*) AS o, count(DISTINCT site) * count(DISTINCT period) AS e FROM sp GROUP BY split UNION ALL
  SELECT split, 'entities', count(DISTINCT site), (SELECT count(*) FROM supplier) + 1 FROM sp GROUP BY split) WHERE o <> e""").replace(" SELECT 'counts'", f", sp AS (SELECT site, period, CASE WHEN year <= {TRAIN_END} THEN 'train' WHEN year <= 1999 THEN 'val' ELSE 'test' END AS split FROM panel) SELECT 'counts'", 1), OE)
def counts(t: Tables):
    from panelwright.functions import assign_split

    sp = t.panel.select("site", "period", assign_split("year", TRAIN_END, 1999).alias("split"))
    n_sites = t.raw("supplier", "s_suppkey").select(F.count(F.lit(1))).scalar()
    expected = sp.groupBy("split").agg((F.count_distinct("site") * F.count_distinct("period")).alias("n_rows")).withColumn("n_entities", n_sites + 1)
    return op.expect_counts(sp, "split", "site", expected)


@query("b07_expect_same_keys", with_(T.MANIFEST, """, cohort AS (SELECT DISTINCT site, month FROM manifest WHERE draw = 'E0'), mk AS (SELECT DISTINCT draw, site, month FROM manifest)
  SELECT 'same_keys' AS "check", draw || '|' || site || '|' || month AS key, 0::DOUBLE AS observed, 1::DOUBLE AS expected
  FROM (SELECT d.draw, c.site, c.month FROM cohort c, (VALUES ('E0'), ('E1'), ('E2'), ('E3')) d(draw) EXCEPT SELECT draw, site, month FROM mk)
  UNION ALL SELECT 'same_keys', draw || '|' || site || '|' || month, 1, 0 FROM (SELECT draw, site, month FROM mk m WHERE NOT EXISTS (SELECT 1 FROM cohort c WHERE c.site = m.site AND c.month = m.month))"""), OE)
def same_keys(t: Tables):
    cohort = t.manifest.where(F.col("draw") == "E0").select("site", "month").distinct()
    return op.expect_same_keys(t.manifest.select("draw", "site", "month"), "draw", DRAWS, cohort, ["site", "month"])


@query("b08_expect_equal_across", with_(T.PREDICTIONS, viol("equal_across", "model || '|' || site::VARCHAR || '|' || period::VARCHAR", "max(y_pred) - min(y_pred)", "1.5", "FROM predictions GROUP BY model, site, period HAVING max(y_pred) - min(y_pred) > 1.5")), OE)
def equal_across(t: Tables):
    return op.expect_equal_across(t.predictions, ["model", "site", "period"], "y_pred", 1.5)


@query("b09_expect_constant_within", with_(T.SITES, """SELECT 'constant_within' AS "check", user_id::VARCHAR || '|' || attr AS key, n::DOUBLE AS observed, 1::DOUBLE AS expected FROM (
  SELECT user_id, 'event_type' AS attr, count(DISTINCT event_type) AS n FROM events GROUP BY user_id UNION ALL SELECT user_id, 'day', count(DISTINCT ts::DATE) FROM events GROUP BY user_id) WHERE n > 1"""), OE)
def constant_within(t: Tables):
    rows = t.raw("events", "user_id", "event_type", "ts").withColumn("day", F.to_date("ts"))
    return op.expect_constant_within(rows, ["user_id"], ["event_type", "day"])


@query("b10_expect_coverage", """SELECT 'coverage' AS "check", coalesce(a.k, b.k)::VARCHAR AS key, (CASE WHEN a.k IS NULL THEN 1 WHEN b.k IS NULL THEN 2 ELSE 3 END)::DOUBLE AS observed, 0::DOUBLE AS expected
  FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""", OE)
def coverage(t: Tables):
    a = t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = t.raw("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return op.expect_coverage(a, b, ["k"], ["v"])


@query("b11_expect_disjoint", viol("disjoint", "user_id::VARCHAR", "count(CASE WHEN dayofmonth(ts) <= 27 THEN 1 END)", "0", "FROM events GROUP BY user_id HAVING count(CASE WHEN dayofmonth(ts) > 27 THEN 1 END) > 0 AND count(CASE WHEN dayofmonth(ts) <= 27 THEN 1 END) > 0"), OE)
def disjoint(t: Tables):
    rows = t.raw("events", "user_id", "ts").select("user_id", F.when(F.dayofmonth("ts") > 27, "test").otherwise("train").alias("role"))
    return op.expect_disjoint(rows, "role", "test", ["user_id"])


@query("b12_expect_join_cardinality", viol("one_to_one:left", "l_orderkey::VARCHAR", "count(*)", "1", "FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"), OE)
def join_cardinality(t: Tables):
    lines = t.raw("lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "k")
    orders = t.raw("orders", "o_orderkey").withColumnRenamed("o_orderkey", "k")
    return op.expect_join_cardinality(lines, orders, ["k"], "one_to_one")


@query("b13_expect_grid", """WITH seen AS (SELECT l_returnflag AS f, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL), grid AS (SELECT f, n::INT AS n FROM (VALUES ('A'), ('N'), ('X')) a(f), range(1, 9) r(n))
  SELECT 'grid' AS "check", coalesce(s.f, g.f) || '|' || coalesce(s.n, g.n) AS key, coalesce(c, 0)::DOUBLE AS observed, (g.f IS NOT NULL)::INT::DOUBLE AS expected
  FROM seen s FULL JOIN grid g ON g.f = s.f AND g.n = s.n WHERE coalesce(c, 0) <> (g.f IS NOT NULL)::INT""", OE)
def grid(t: Tables):
    return op.expect_grid(t.raw("lineitem", "l_returnflag", "l_linenumber"), "l_returnflag", ["A", "N", "X"], "l_linenumber", list(range(1, 9)))


_RULE = "(active = 1 AND coalesce(good_fraction >= 0.75, false))"


@query("b14_flag_identity", "WITH " + T.FLAGGED + f""" SELECT count(CASE WHEN e THEN 1 END) AS explicit_n, count(CASE WHEN f THEN 1 END) AS flagged_n, count(CASE WHEN e AND f THEN 1 END) AS both_n,
  count(CASE WHEN e AND NOT f THEN 1 END) AS missing_n, count(CASE WHEN f AND NOT e THEN 1 END) AS extra_n, CASE WHEN count(CASE WHEN e <> f THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT {_RULE} AS e, eligible_qa1 = 1 AS f FROM flagged)""")
def flag_identity(t: Tables):
    rule = (F.col("active") == 1) & (F.col("good_fraction") >= 0.75)
    return op.flag_identity(t.flagged, rule, F.col("eligible_qa1") == 1)


@query("b14_flag_mismatches", "WITH " + T.FLAGGED + f" SELECT site, period, {_RULE} AS explicit, eligible_qa1 = 1 AS flagged FROM flagged WHERE {_RULE} <> (eligible_qa1 = 1)")
def flag_mismatches(t: Tables):
    rule = (F.col("active") == 1) & (F.col("good_fraction") >= 0.75)
    return op.flag_mismatches(t.flagged, rule, F.col("eligible_qa1") == 1, ["site", "period"])


@query("b15_reconstruct_check", "WITH " + T.MASTER + """ SELECT count(*) AS n, round(max(abs((net - net_mean) - net_anomaly_median)), 8) AS max_abs_difference,
  count(CASE WHEN abs((net - net_mean) - net_anomaly_median) > 0.05 THEN 1 END) AS mismatches, CASE WHEN count(CASE WHEN abs((net - net_mean) - net_anomaly_median) > 0.05 THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM master""", "max_abs_difference")
def reconstruct(t: Tables):
    return op.reconstruct_check(t.master, F.col("net") - F.col("net_mean"), "net_anomaly_median", 0.05)


@query("b16_expect_centered", "WITH " + T.MASTER + ", g AS (" + viol("centered", "site::VARCHAR || '|' || month::VARCHAR", "avg(net_anomaly_mean)", "0", "FROM master GROUP BY site, month HAVING abs(avg(net_anomaly_mean)) > 0.5") + ") SELECT * FROM g", OE)
def centered(t: Tables):
    return op.expect_centered(t.master, ["site", "month"], "net_anomaly_mean", 0.5)


@query("b17_semantic_range_check", with_(T.DENSE, " UNION ALL ".join(
    f"SELECT '{c}' AS field, min({c}) AS minimum, max({c}) AS maximum, count(CASE WHEN {c} IS NULL THEN 1 END) AS nonfinite, CASE WHEN count(CASE WHEN {c} IS NULL THEN 1 END) = 0 AND min({c}) > {lo} AND max({c}) < {hi} THEN 'PASS' ELSE 'FAIL' END AS status FROM dense"
    for c, lo, hi in (("heat", -100, 100), ("peak", 0, 51), ("period", 0, 30000)))), "minimum maximum")
def semantic_range(t: Tables):
    return op.semantic_range_check(t.dense, {"heat": (-100, 100), "peak": (0, 51), "period": (0, 30000)})


@query("b18_sample_id_check", """SELECT 'sample_id' AS "check", l_orderkey::VARCHAR || '|' || l_suppkey::VARCHAR AS key, 1::DOUBLE AS observed, 0::DOUBLE AS expected
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IS NULL OR o_custkey <> l_suppkey""", OE)
def sample_id(t: Tables):
    manifest = t.raw("lineitem", "l_orderkey", "l_suppkey").withColumnsRenamed({"l_orderkey": "sample_id", "l_suppkey": "point"})
    index = t.raw("orders", "o_orderkey", "o_custkey").withColumnsRenamed({"o_orderkey": "sample_id", "o_custkey": "point"})
    return op.sample_id_check(manifest, index, "sample_id", ["point"])


@query("b19_field_completeness", with_(T.DENSE, " UNION ALL ".join(
    f"SELECT year, '{c}' AS field, count(*) AS n, count(CASE WHEN {c} IS NULL THEN 1 END) AS missing, 0::BIGINT AS nonfinite, CASE WHEN count(CASE WHEN {c} IS NULL THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM dense GROUP BY year" for c in ("target", "heat", "period"))))
def completeness(t: Tables):
    return op.field_completeness(t.dense, ["target", "heat", "period"], ["year"])


@query("b20_key_identity", with_(T.MANIFEST, """, a AS (SELECT site, month FROM manifest WHERE draw = 'E0'), b AS (SELECT site, month FROM manifest WHERE draw = 'E3'),
  k AS (SELECT site, month, sum(x) AS x, sum(y) AS y FROM (SELECT site, month, 1 AS x, 0 AS y FROM a UNION ALL SELECT site, month, 0, 1 FROM b) GROUP BY ALL)
  SELECT sum(x)::BIGINT AS n_a, sum(y)::BIGINT AS n_b, count(DISTINCT CASE WHEN x > 0 THEN site END) AS entities_a, count(DISTINCT CASE WHEN y > 0 THEN site END) AS entities_b,
    sum(greatest(x - 1, 0))::BIGINT AS duplicates_a, sum(greatest(y - 1, 0))::BIGINT AS duplicates_b, count(CASE WHEN x > 0 AND y = 0 THEN 1 END) AS missing, count(CASE WHEN x = 0 AND y > 0 THEN 1 END) AS extra,
    CASE WHEN max(x) <= 1 AND max(y) <= 1 AND count(CASE WHEN (x > 0) <> (y > 0) THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM k"""))
def key_identity(t: Tables):
    a, b = (t.manifest.where(F.col("draw") == d).select("site", "month") for d in ("E0", "E3"))
    return op.key_identity(a, b, ["site", "month"], "site")


def _line_rules() -> list[suite.Rule]:
    return [
        *suite.finite_rules(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), *suite.integer_rules(["l_orderkey", "l_extendedprice"], "l_linenumber"),
        suite.domain_rule("l_returnflag", ["A", "N"]), suite.domain_rule("l_linestatus", ["O", "F"]),
        suite.range_rule("l_quantity", 1, 45, ["l_quantity"]), suite.range_rule("l_discount", 0.0, 0.05), suite.range_rule("l_tax", 0.0, 1.0),
        suite.definition_rule("l_tax", F.floor(F.col("l_tax") * 100 + 0.5) / F.lit(100.0), 1e-9), suite.flag_rule("returned", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", ["l_linestatus"]),
    ]


_LINE = [
    *[("finite", f"'{c}'", f"{c} IS NULL") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    *[("integer_keys", f"'{c}'", f"{c} IS NULL OR {c} <> floor({c})") for c in ("l_orderkey", "l_extendedprice")], ("integer_keys", "'l_linenumber'", "l_linenumber IS NULL OR l_linenumber NOT BETWEEN 1 AND 12"),
    ("domain", "coalesce(l_returnflag, 'null')", "l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')"), ("domain", "coalesce(l_linestatus, 'null')", "l_linestatus IS NULL OR l_linestatus NOT IN ('O', 'F')"),
    ("range", "l_quantity::VARCHAR", "l_quantity NOT BETWEEN 1 AND 45"), ("range", "'l_discount'", "l_discount NOT BETWEEN 0 AND 0.05::DOUBLE"), ("range", "'l_tax'", "l_tax NOT BETWEEN 0 AND 1"),
    ("definition", "'l_tax'", "abs(floor(l_tax * 100 + 0.5) / 100.0::DOUBLE - l_tax) > 1e-9::DOUBLE"), ("flag", "coalesce(l_linestatus, 'null')", "coalesce(l_returnflag = 'R', false) <> coalesce(l_linestatus = 'F', false)"),
]


@query("b_rule_suite", " UNION ALL ".join(f"SELECT '{check}' AS \"check\", {key} AS key, count(*)::DOUBLE AS observed, 0::DOUBLE AS expected FROM lineitem WHERE {broken} GROUP BY ALL HAVING count(*) > 0" for check, key, broken in _LINE), OE)
def rule_suite(t: Tables):
    return suite.run_rules(t.raw("lineitem"), _line_rules())


@query("b_rule_report", " UNION ALL ".join(f"SELECT '{r[0]}' AS \"check\", '{k}' AS key, count(*) AS rows, count(CASE WHEN {r[2]} THEN 1 END) AS broken, CASE WHEN count(CASE WHEN {r[2]} THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem"
       for r, k in zip(_LINE, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_extendedprice", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_tax", "returned"])))
def rule_report(t: Tables):
    return suite.rule_report(t.raw("lineitem"), _line_rules())
