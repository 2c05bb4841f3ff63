"""Distribution shift, rank agreement and overlap."""

from pyspark.sql import functions as F

from panelwright.operators import agreement as op, attribution
from panelwright.plans import tables as T
from panelwright.plans.attribution_queries import CLASSES, IMPORTANCE, TOP2
from panelwright.plans.registry import query
from panelwright.plans.resampling_queries import SHARES, site_shares
from panelwright.plans.tables import DRAWS, FEATURES, TEST_START, TRAIN_END, WINDOW, Tables, with_

RUN_PAIRS = [("model_seed", "r1", "r2"), ("model_seed", "r1", "r3")]
PAIR_VALUES = "(VALUES ('model_seed', 'r1', 'r2'), ('model_seed', 'r1', 'r3')) p(family, left_run, right_run)"

VIEWS = f""", views AS (SELECT 'lag-1' AS view, feature, value, year FROM features_long WHERE lag = 1 UNION ALL SELECT 'pooled', feature, value, year FROM features_long),
  tr AS (SELECT view, feature, value FROM views WHERE year <= {TRAIN_END}), ev AS (SELECT view, feature, value FROM views WHERE year >= {TEST_START}),
  wcounts AS (SELECT view, feature, value, sum(a) AS a, sum(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM tr UNION ALL SELECT *, 0, 1 FROM ev) GROUP BY ALL),
  wcum AS (SELECT view, feature, value, sum(a) OVER w / sum(a) OVER (PARTITION BY view, feature)::DOUBLE AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY view, feature)::DOUBLE AS fb, lead(value) OVER w AS nxt FROM wcounts WINDOW w AS (PARTITION BY view, feature ORDER BY value)),
  w1 AS (SELECT view, feature, sum(abs(fa - fb) * (nxt - value)) AS wasserstein FROM wcum GROUP BY ALL)"""


def _views(t: Tables):
    f = t.features_long
    both = F.array(F.when(F.col("lag") == 1, F.lit("lag-1")), F.lit("pooled"))
    return f.withColumn("view", F.explode(F.array_compact(both))).select("view", "feature", "value", "year")


def _train_eval(t: Tables):
    v = _views(t)
    return v.where(F.col("year") <= TRAIN_END), v.where(F.col("year") >= TEST_START)


@query("j01_wasserstein_1d", with_(T.FEATURES_LONG + VIEWS, "SELECT view, feature, n_a, n_b, wasserstein FROM w1 JOIN (SELECT view, feature, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM wcounts GROUP BY ALL) USING (view, feature)"), "wasserstein")
def wasserstein(t: Tables):
    a, b = _train_eval(t)
    return op.wasserstein_1d(a, b, "value", ["view", "feature"])


@query("j02_shift_summary", with_(T.FEATURES_LONG + VIEWS, """, q AS (SELECT view, feature, count(*) AS training_n, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.99) AS p99 FROM tr GROUP BY ALL),
  e AS (SELECT view, feature, count(*) AS evaluation_n, quantile_cont(value, 0.5) AS m FROM ev GROUP BY ALL), o AS (SELECT view, feature, avg((value < p01 OR value > p99)::INT) AS outside_share FROM ev JOIN q USING (view, feature) GROUP BY ALL)
  SELECT *, CASE WHEN abs(median_shift) < 0.25 AND wasserstein_iqr < 0.25 AND outside_share < 0.05 THEN 'limited' WHEN abs(median_shift) < 0.5 AND wasserstein_iqr < 0.5 AND outside_share < 0.1 THEN 'moderate' ELSE 'pronounced' END AS shift_class FROM (
  SELECT view, feature, training_n, evaluation_n, (m - q50) / (q75 - q25) AS median_shift, wasserstein / (q75 - q25) AS wasserstein_iqr, outside_share FROM q JOIN e USING (view, feature) JOIN o USING (view, feature) JOIN w1 USING (view, feature))"""), "median_shift wasserstein_iqr outside_share")
def shift(t: Tables):
    a, b = _train_eval(t)
    return op.shift_summary(a, b, "value", ["view", "feature"])


def rank_sql(c: str, part: str) -> str:
    return f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0::DOUBLE"


@query("j03_spearman", with_(T.PANEL, f"SELECT class, count(*) AS n, corr(rx, ry) AS spearman FROM (SELECT class, {rank_sql('load', 'class')} AS rx, {rank_sql('peak', 'class')} AS ry FROM panel) GROUP BY class"), "spearman")
def spearman(t: Tables):
    return op.spearman(t.panel.select("class", "load", "peak"), "load", "peak", ["class"])


def kendall_sql(x: str, y: str, source: str, part: str) -> str:
    """Tau-b from all pairs; the twin may be quadratic, the operator is not."""
    keys = " AND ".join(f"b.{p} = a.{p}" for p in part.split(", "))
    cols = ", ".join(f"a.{p}" for p in part.split(", "))
    return f"""SELECT {cols}, sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) / sqrt(sum((a.{x} <> b.{x})::INT)::DOUBLE * sum((a.{y} <> b.{y})::INT)::DOUBLE) AS kendall
      FROM {source} a JOIN {source} b ON {keys} AND b.rid < a.rid GROUP BY {cols}"""


@query("j04_kendall_tau_b", with_(T.PANEL, f""", src AS (SELECT class, month, load, peak, row_number() OVER (ORDER BY site, period) AS rid FROM panel)
  SELECT class, month, n, kendall FROM ({kendall_sql('load', 'peak', 'src', 'class, month')}) JOIN (SELECT class, month, count(*) AS n FROM src GROUP BY ALL) USING (class, month)"""), "kendall")
def kendall(t: Tables):
    return op.kendall_tau_b(t.panel.select("class", "month", "site", "period", "load", "peak"), "load", "peak", ["class", "month"], ["site", "period"])


_PAIRS5 = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
MATRIX = ", rk AS (SELECT " + ", ".join(f"{rank_sql(f, '1')} AS {f}" for f in FEATURES) + " FROM panel), mat AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS spearman, count(*) AS n_rows FROM rk" for a, b in _PAIRS5
) + ")"


def _matrix(t: Tables):
    from panelwright.functions import to_long

    return op.spearman_matrix(to_long(t.panel, ["site", "period"], FEATURES), ["site", "period"], FEATURES)


@query("j05_spearman_matrix", with_(T.PANEL + MATRIX, "SELECT * FROM mat"), "spearman")
def matrix(t: Tables):
    return _matrix(t)


@query("j05_high_correlation_pairs", with_(T.PANEL + MATRIX, "SELECT *, abs(spearman) AS abs_spearman FROM mat WHERE abs(spearman) >= 0.7"), "spearman abs_spearman")
def high_pairs(t: Tables):
    return op.high_correlation_pairs(_matrix(t), 0.7)


@query("j06_run_stability", with_(T.ATTRIBUTIONS + IMPORTANCE, f""", pr AS (SELECT p.*, a.feature, a.rank AS x, b.rank AS y, a.sign AS sx, b.sign AS sy, row_number() OVER (ORDER BY family, left_run, right_run, a.feature) AS rid FROM {PAIR_VALUES} JOIN importance a ON a.run = left_run JOIN importance b ON b.run = right_run AND b.feature = a.feature)
  SELECT * FROM (SELECT family, left_run, right_run, count(*) AS n_entities, count(CASE WHEN x <= 2 AND y <= 2 THEN 1 END) AS top2_overlap, count(CASE WHEN x <= 10 AND y <= 10 THEN 1 END) AS top10_overlap, avg((sx = sy)::INT) AS sign_agreement,
    count(CASE WHEN x <= 2 AND y <= 2 THEN 1 END) / 2.0::DOUBLE AS top2_proportion, count(CASE WHEN x <= 10 AND y <= 10 THEN 1 END) / least(10, count(*))::DOUBLE AS top10_proportion, corr(x, y) AS spearman FROM pr GROUP BY ALL)
  JOIN ({kendall_sql('x', 'y', 'pr', 'family, left_run, right_run')}) USING (family, left_run, right_run)"""), "sign_agreement top2_proportion top10_proportion spearman kendall")
def run_stability(t: Tables):
    imp = attribution.global_importance(t.attributions, ["run"]).withColumnRenamed("feature", "entity")
    return op.run_stability(op.run_pairs(imp, "run", RUN_PAIRS, ["entity"], ["rank", "sign"]), "entity", (2, 10))


@query("j07_site_run_comparison", with_(SHARES, f""", pr AS (SELECT p.*, a."group" AS grp, a.site, a.group_abs AS x, b.group_abs AS y, row_number() OVER (ORDER BY family, left_run, right_run, a."group", a.site) AS rid
    FROM {PAIR_VALUES} JOIN shares a ON a.run = left_run JOIN shares b ON b.run = right_run AND b."group" = a."group" AND b.site = a.site),
  rho AS (SELECT family, left_run, right_run, grp, count(*) AS matched_sites, corr(rx, ry) AS spearman FROM (SELECT *, {rank_sql('x', 'left_run, right_run, grp')} AS rx, {rank_sql('y', 'left_run, right_run, grp')} AS ry FROM pr) GROUP BY ALL),
  tau AS ({kendall_sql('x', 'y', 'pr', 'family, left_run, right_run, grp')}),
  dm AS (SELECT run, site, min("group") AS g FROM shares WHERE dominant = 1 GROUP BY ALL), dp AS (SELECT p.*, a.g AS x, b.g AS y FROM {PAIR_VALUES} JOIN dm a ON a.run = left_run JOIN dm b ON b.run = right_run AND b.site = a.site),
  ag AS (SELECT family, left_run, right_run, avg((x = y)::INT) AS agreement, count(*) AS n FROM dp GROUP BY ALL),
  ex AS (SELECT family, left_run, right_run, sum(cx * cy)::DOUBLE AS e FROM (SELECT family, left_run, right_run, x AS c, count(*) AS cx FROM dp GROUP BY ALL) JOIN (SELECT family, left_run, right_run, y AS c, count(*) AS cy FROM dp GROUP BY ALL) USING (family, left_run, right_run, c) GROUP BY ALL)
  SELECT rho.family, rho.left_run, rho.right_run, rho.grp AS "group", matched_sites, spearman, kendall, agreement, (agreement - e / n / n) / nullif(1 - e / n / n, 0) AS kappa,
    CASE WHEN spearman >= 0.8 THEN 'STRONG' WHEN spearman >= 0.6 THEN 'MODERATE' ELSE 'WEAK' END AS spatial_class, CASE WHEN agreement >= 0.7 THEN 'STRONG' WHEN agreement >= 0.5 THEN 'MODERATE' ELSE 'WEAK' END AS dominant_class
  FROM rho JOIN tau USING (family, left_run, right_run, grp) JOIN ag USING (family, left_run, right_run) JOIN ex USING (family, left_run, right_run)"""), "spearman kendall agreement kappa")
def site_run(t: Tables):
    return op.site_run_comparison(site_shares(t), "run", RUN_PAIRS, "site")


@query("j08_cohen_kappa", """WITH s AS (SELECT l_suppkey % 5 AS g, l_returnflag AS a, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS b FROM lineitem), ca AS (SELECT g, a AS c, count(*) AS n FROM s GROUP BY ALL), cb AS (SELECT g, b AS c, count(*) AS n FROM s GROUP BY ALL),
  o AS (SELECT g, count(*) AS n, avg((a = b)::INT) AS agreement FROM s GROUP BY g), e AS (SELECT g, sum(ca.n * cb.n)::DOUBLE AS e FROM ca JOIN cb USING (g, c) GROUP BY g)
  SELECT g, n, agreement, e / n / n AS expected, (agreement - e / n / n) / (1 - e / n / n) AS kappa FROM o JOIN e USING (g)""", "agreement expected kappa")
def kappa(t: Tables):
    size = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    rows = t.raw("lineitem", "l_suppkey", "l_returnflag", "l_quantity").select(F.pmod("l_suppkey", F.lit(5)).alias("g"), "l_returnflag", size.alias("size"))
    return op.cohen_kappa(rows, "l_returnflag", "size", ["g"])


COMP = f""", pr AS (SELECT p.*, a.class, a."group", a.share AS x, b.share AS y, a.margin AS mx, b.margin AS my, a.top1_group AS gx, b.top1_group AS gy, row_number() OVER (ORDER BY family, left_run, right_run, a.class, a."group") AS rid
    FROM {PAIR_VALUES} JOIN top2 a ON a.run = left_run JOIN top2 b ON b.run = right_run AND b.class = a.class AND b."group" = a."group"),
  cl AS (SELECT family, left_run, right_run, class, avg(abs(y - x)) AS mean_abs_difference, max(abs(y - x)) AS max_abs_difference, sum(abs(y - x)) AS l1_distance, max(my - mx) AS margin_change, max((gx = gy)::INT) AS same_top1 FROM pr GROUP BY ALL)"""


@query("j09_composition_distance", with_(SHARES + CLASSES + TOP2 + COMP, "SELECT * FROM cl"), "mean_abs_difference max_abs_difference l1_distance margin_change")
def composition(t: Tables):
    return op.composition_distance(attribution.class_top2(site_shares(t), ["run"], "class"), "run", RUN_PAIRS, "class")[0]


@query("j09_composition_overall", with_(SHARES + CLASSES + TOP2 + COMP, f"""SELECT * FROM (SELECT family, left_run, right_run, count(*) AS n_classes, sum(same_top1)::BIGINT AS n_same_top1, avg(same_top1) AS top1_agreement FROM cl GROUP BY ALL) JOIN
  (SELECT family, left_run, right_run, count(*) AS n_cells, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM (SELECT *, {rank_sql('x', 'left_run, right_run')} AS rx, {rank_sql('y', 'left_run, right_run')} AS ry FROM pr) GROUP BY ALL) USING (family, left_run, right_run)
  JOIN ({kendall_sql('x', 'y', 'pr', 'family, left_run, right_run')}) USING (family, left_run, right_run)"""), "top1_agreement pearson spearman kendall")
def composition_overall(t: Tables):
    return op.composition_distance(attribution.class_top2(site_shares(t), ["run"], "class"), "run", RUN_PAIRS, "class")[1]


YEARS = list(range(1995, 2002))


@query("j10_sample_composition", with_(T.MANIFEST, "SELECT a.*, b.* EXCLUDE (draw) FROM (SELECT draw, count(*) AS n_samples, count(DISTINCT (year, month)) AS n_year_months, "
  + ", ".join([f"count(CASE WHEN year = {y} THEN 1 END) AS year_{y}" for y in YEARS] + [f"count(CASE WHEN month = {m} THEN 1 END) AS month_{m:02d}" for m in range(1, 13)] + [f"count(CASE WHEN class = {c} THEN 1 END) AS class_c{c}" for c in range(5)])
  + """ FROM manifest GROUP BY draw) a JOIN (SELECT draw, count(*) AS n_sites, avg(k) AS samples_per_site_mean, quantile_cont(k, 0.5)::DOUBLE AS samples_per_site_median, min(k) AS samples_per_site_min, max(k) AS samples_per_site_max
  FROM (SELECT draw, site, count(*) AS k FROM manifest GROUP BY ALL) GROUP BY draw) b ON b.draw = a.draw"""), "samples_per_site_mean samples_per_site_median")
def sample_composition(t: Tables):
    return op.sample_composition(t.manifest, "draw", "site", YEARS, {f"c{c}": c for c in range(5)}, "class")


PAIRS4 = ", ".join(f"('{a}', '{b}')" for i, a in enumerate(DRAWS) for b in DRAWS[i + 1:])


@query("j11_pairwise_overlap", with_(T.MANIFEST, f""", prs AS (SELECT * FROM (VALUES {PAIRS4}) p(set_a, set_b)), sz AS (SELECT draw, count(*) AS n FROM manifest GROUP BY draw), mc AS (SELECT d.draw, m.m AS month, (SELECT count(*) FROM manifest x WHERE x.draw = d.draw AND x.month = m.m) AS c FROM sz d, range(1, 13) m(m)),
  sh AS (SELECT set_a, set_b, (SELECT count(*) FROM manifest a JOIN manifest b USING (site, year, month) WHERE a.draw = set_a AND b.draw = set_b) AS n_shared FROM prs)
  SELECT set_a, set_b, a.n AS n_a, b.n AS n_b, n_shared, 0.5 * (SELECT sum(abs(x.c / a.n::DOUBLE - y.c / b.n::DOUBLE)) FROM mc x JOIN mc y ON y.month = x.month WHERE x.draw = set_a AND y.draw = set_b) AS month_tvd,
    n_shared / a.n::DOUBLE AS proportion_a, n_shared / b.n::DOUBLE AS proportion_b FROM sh JOIN sz a ON a.draw = set_a JOIN sz b ON b.draw = set_b"""), "month_tvd proportion_a proportion_b")
def pairwise_overlap(t: Tables):
    return op.pairwise_overlap(t.manifest, "draw", DRAWS, ["site", "year", "month"])


@query("j11_month_differences", with_(T.MANIFEST, f", prs AS (SELECT * FROM (VALUES {PAIRS4}) p(set_a, set_b)), mc AS (SELECT draw, month, count(*) AS c FROM manifest GROUP BY ALL) SELECT x.month, set_a, set_b, x.c AS count_a, y.c AS count_b, y.c - x.c AS difference FROM prs JOIN mc x ON x.draw = set_a JOIN mc y ON y.draw = set_b AND y.month = x.month"))
def month_differences(t: Tables):
    return op.month_differences(t.manifest, "draw", DRAWS, "month")


WITHIN = f""", prs AS (SELECT * FROM (VALUES {PAIRS4}) p(set_a, set_b)), mm AS (SELECT DISTINCT draw, site, month FROM manifest),
  ys AS (SELECT draw, site, count(*) AS n FROM manifest GROUP BY ALL), ms AS (SELECT draw, site, count(*) AS n FROM mm GROUP BY ALL),
  yi AS (SELECT a.draw AS set_a, b.draw AS set_b, a.site AS s, count(*) AS n FROM manifest a JOIN manifest b ON b.site = a.site AND b.year = a.year AND b.month = a.month GROUP BY ALL),
  mi AS (SELECT a.draw AS set_a, b.draw AS set_b, a.site AS s, count(*) AS n FROM mm a JOIN mm b ON b.site = a.site AND b.month = a.month GROUP BY ALL),
  det AS (SELECT prs.set_a, prs.set_b, a.site, a.n AS year_month_a, b.n AS year_month_b, coalesce(yi.n, 0) AS year_month_shared, coalesce(yi.n, 0) / (a.n + b.n - coalesce(yi.n, 0))::DOUBLE AS year_month_jaccard,
    c.n AS month_a, d.n AS month_b, coalesce(mi.n, 0) AS month_shared, coalesce(mi.n, 0) / (c.n + d.n - coalesce(mi.n, 0))::DOUBLE AS month_jaccard
    FROM prs JOIN ys a ON a.draw = prs.set_a JOIN ys b ON b.draw = prs.set_b AND b.site = a.site JOIN ms c ON c.draw = prs.set_a AND c.site = a.site JOIN ms d ON d.draw = prs.set_b AND d.site = a.site
    LEFT JOIN yi ON yi.set_a = prs.set_a AND yi.set_b = prs.set_b AND yi.s = a.site LEFT JOIN mi ON mi.set_a = prs.set_a AND mi.set_b = prs.set_b AND mi.s = a.site)"""


@query("j12_within_site_overlap", with_(T.MANIFEST + WITHIN, "SELECT * FROM det"), "year_month_jaccard month_jaccard")
def within_site(t: Tables):
    return op.within_site_overlap(t.manifest, "draw", DRAWS, "site")


@query("j12_within_site_summary", with_(T.MANIFEST + WITHIN, """, long AS (SELECT set_a, set_b, year_month_shared AS s, u.* FROM det, LATERAL (VALUES ('year_month_shared', year_month_shared::DOUBLE), ('year_month_jaccard', year_month_jaccard), ('month_shared', month_shared::DOUBLE), ('month_jaccard', month_jaccard)) u(metric, value))
  SELECT set_a, set_b, metric, count(*) AS matched_sites, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS min, max(value) AS max,
    avg((s = 0)::INT) AS fraction_zero, avg((s <= 1)::INT) AS fraction_le_1, avg((s >= 2)::INT) AS fraction_ge_2 FROM long GROUP BY ALL"""), "q1 median q3 iqr min max fraction_zero fraction_le_1 fraction_ge_2")
def within_summary(t: Tables):
    return op.within_site_summary(op.within_site_overlap(t.manifest, "draw", DRAWS, "site"))
