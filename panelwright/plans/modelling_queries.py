"""Folds, ridge, forest and the additive surface on the panel."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import modelling as op
from panelwright.operators.gram import gram_table, nested_ridge, predict_levels
from panelwright.operators.metrics import METRICS
from panelwright.operators.ordering import exact_quantiles
from panelwright.plans import tables as T
from panelwright.plans.joins_queries import draws_sql
from panelwright.plans.registry import query
from panelwright.plans.resampling_queries import FROM_SUMS, TOTALS
from panelwright.session import cut_lineage
from panelwright.plans.tables import FEATURES, METRICS_SQL, SEED, TEST_START, TRAIN_END, WINDOW, Tables, with_

FOLDS = list(range(5))
REPS = 5000
SUCCESSES, ATTEMPTS = 2000, 2100
#: A hundredth of the reference's 300 and 600 trees; see the README for what those take.
TREES = [3, 6]
# The ridge penalties.
ALPHAS = [1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0, 1000000.0]

SPEC = op.AdditiveSpec(
    response="net_anomaly_mean", x="water_rank", y="energy_rank", knots=(0.0, 0.5, 1.0),
    controls={"water_ante3": (3.0, 5.5, 8.0), "energy_ante3": (0.5, 1.5, 2.5), "heat_lag1": (0.3, 0.5, 0.7), "heat_anomaly_mean": (-0.2, 0.0, 0.2)},
    months=tuple(range(1, 13)), years=(2000, 2001), site="site", time="period",
)


# --- ridge by sums, in SQL --------------------------------------------------------------------

N_FEATURES = WINDOW * len(FEATURES)
SEEDS = [1, 2, 3]


def solve_sql(name: str, keys: str, system: str, p: int) -> str:
    """Gauss-Jordan elimination of `m`, p rows of p + 1 numbers, per key: `{name}` has (keys, x), the solution as a list."""
    step = "list_transform(m, lambda r, i: CASE WHEN i = k THEN pv ELSE list_transform(r, lambda x, j: x - r[k] * pv[j]) END)"
    return f"""{name}_steps AS (SELECT {keys}, 1 AS k, m FROM {system} UNION ALL
    SELECT {keys}, k + 1, {step} FROM (SELECT {keys}, k, m, list_transform(m[k], lambda x: x / m[k][k]) AS pv FROM {name}_steps WHERE k <= {p})),
  {name} AS (SELECT {keys}, list_transform(m, lambda r: r[{p + 1}]) AS x FROM {name}_steps WHERE k = {p + 1})"""


def ridge_sql(name: str, keys: str, grams: str, p: int) -> str:
    """Ridge coefficients `{name}` (keys, alpha, beta = [intercept, coefficients]) for all penalties; `grams` is (keys, i, j, v) of [1, x, y]."""
    same = " AND ".join(f"s.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    also = same.replace("s.", "t.")
    g_keys = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""{name}_c AS (SELECT {g_keys}, g.i, g.j, g.v - s.v * t.v / n.v AS c FROM {grams} g JOIN {grams} s ON {same} AND s.i = 0 AND s.j = g.i JOIN {grams} t ON {also} AND t.i = 0 AND t.j = g.j
    JOIN {grams} n ON {same.replace("s.", "n.")} AND n.i = 0 AND n.j = 0 WHERE g.i BETWEEN 1 AND {p} AND g.j BETWEEN 1 AND {p + 1}),
  {name}_m AS (SELECT {keys}, alpha, list(r ORDER BY i) AS m FROM (SELECT {keys}, alpha, i, list(c + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS r FROM {name}_c, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha) GROUP BY ALL) GROUP BY ALL),
  {solve_sql(name + "_x", keys + ", alpha", name + "_m", p)},
  {name} AS (SELECT {g_keys}, x.alpha, list_concat([(s.y - list_inner_product(s.m, x.x)) / s.n], x.x) AS beta FROM {name}_x x JOIN
    (SELECT {keys}, max(v) FILTER (WHERE j = 0) AS n, max(v) FILTER (WHERE j = {p + 1}) AS y, list(v ORDER BY j) FILTER (WHERE j BETWEEN 1 AND {p}) AS m FROM {grams} WHERE i = 0 GROUP BY ALL) s ON {same.replace("g.", "x.")}, (SELECT 1) z)""".replace(f"SELECT {g_keys}, x.alpha", "SELECT " + g_keys.replace("g.", "x.") + ", x.alpha")


#: Samples with [1, history, target] as one list `v`.
VECTORS = T.FEATURES_LONG + f""", vectors AS (SELECT s.*, (s.site % 5)::INT AS fold, h.v FROM samples s JOIN (
    SELECT site, period, list_concat([1.0::DOUBLE], list(value::DOUBLE ORDER BY ({WINDOW} - lag) * {len(FEATURES)} + fi), [any_value(target)::DOUBLE]) AS v
    FROM features_long f JOIN samples USING (site, period) GROUP BY site, period) h ON h.site = s.site AND h.period = s.period)"""
PREDICTED = f"list_inner_product(v[1:{N_FEATURES + 1}], beta)"


def gram_sql(name: str, keys: str, source: str) -> str:
    return f"{name} AS (SELECT {keys}, a.i::INT AS i, b.j::INT AS j, sum(v[a.i + 1] * v[b.j + 1]) AS v FROM {source}, range({N_FEATURES + 2}) a(i), range({N_FEATURES + 2}) b(j) GROUP BY ALL)"


# --- folds and out-of-fold predictions ------------------------------------------------------

def _roles(rows: DataFrame) -> DataFrame:
    folds = rows.withColumn("fold", F.pmod("site", F.lit(5)).cast("int"))
    return op.spatial_folds(folds, "fold", FOLDS, (0, TRAIN_END), (TRAIN_END + 1, TEST_START - 1), (TEST_START, 9999))


def roles_sql(source: str) -> str:
    return f""", roles AS (SELECT site, class, fold, h.f::INT AS held_out, year, month, period, target,
    CASE WHEN fold <> h.f AND year <= {TRAIN_END} THEN 'train' WHEN fold <> h.f AND year < {TEST_START} THEN 'val' WHEN fold = h.f AND year >= {TEST_START} THEN 'test' END AS role
  FROM (SELECT *, (site % 5)::INT AS fold FROM {source}), range(5) h(f))"""


#: Three candidates on the samples with a complete history: climatology by month, by class and month, and ridge on the history.
CANDIDATES = VECTORS.replace("WITH ", "") + roles_sql("samples") + f""",
  clim1 AS (SELECT held_out, month, s.seed, avg(target) FILTER (WHERE year <> 1994 + s.seed) AS y_pred FROM roles, (SELECT unnest({SEEDS})::INT AS seed) s WHERE role = 'train' GROUP BY ALL),
  clim2 AS (SELECT held_out, class, month, s.seed, avg(target) FILTER (WHERE year <> 1994 + s.seed) AS y_pred FROM roles, (SELECT unnest({SEEDS})::INT AS seed) s WHERE role = 'train' GROUP BY ALL),
  {gram_sql("by_block", "fold, year", f"(SELECT fold, year, v FROM vectors WHERE year <= {TRAIN_END}) v")},
  fold_grams AS (SELECT h.f::INT AS held_out, s.seed, i, j, sum(v) AS v FROM by_block, range(5) h(f), (SELECT unnest({SEEDS})::INT AS seed) s WHERE fold <> h.f AND year <> 1994 + s.seed GROUP BY ALL),
  {ridge_sql("fits", "held_out, seed", "fold_grams", N_FEATURES)},
  tried AS (SELECT f.held_out, f.seed, alpha, avg(({PREDICTED} - target) * ({PREDICTED} - target)) AS mse FROM fits f JOIN vectors v ON v.fold <> f.held_out AND v.year > {TRAIN_END} AND v.year < {TEST_START} GROUP BY ALL),
  penalty AS (SELECT held_out, arg_min(alpha, (mse, alpha)) AS alpha FROM (SELECT held_out, alpha, avg(mse) AS mse FROM tried GROUP BY ALL) GROUP BY held_out),
  cand AS (SELECT r.held_out, r.role, r.site, r.year, r.month, r.period, r.target AS y_true, c.seed, 1 AS candidate, c.y_pred FROM roles r JOIN clim1 c ON c.held_out = r.held_out AND c.month = r.month WHERE role <> 'train' AND c.y_pred IS NOT NULL
    UNION ALL SELECT r.held_out, r.role, r.site, r.year, r.month, r.period, r.target, c.seed, 2, c.y_pred FROM roles r JOIN clim2 c ON c.held_out = r.held_out AND c.class = r.class AND c.month = r.month WHERE role <> 'train' AND c.y_pred IS NOT NULL
    UNION ALL SELECT r.held_out, r.role, r.site, r.year, r.month, r.period, r.target, f.seed, 3, {PREDICTED} FROM roles r JOIN vectors v ON v.site = r.site AND v.period = r.period JOIN penalty q ON q.held_out = r.held_out JOIN fits f ON f.held_out = r.held_out AND f.alpha = q.alpha WHERE role <> 'train'),
  scores AS (SELECT held_out, candidate, seed, avg((y_pred - y_true) * (y_pred - y_true)) AS mse FROM cand WHERE role = 'val' GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY mean, median, candidate) AS rn FROM (SELECT held_out, candidate, count(*) AS n_scores, avg(mse) AS mean, quantile_cont(mse, 0.5) AS median FROM scores GROUP BY ALL)),
  chosen AS (SELECT held_out, 'nested' AS arm, candidate, n_scores, mean, median FROM best WHERE rn = 1 UNION ALL SELECT held_out, 'fixed', candidate, n_scores, mean, median FROM best WHERE candidate = 2),
  oof AS (SELECT c.held_out, arm, c.candidate, seed, site, year, month, period, y_true, y_pred FROM cand c JOIN chosen h ON h.held_out = c.held_out AND h.candidate = c.candidate WHERE role = 'test')"""


def _vectors(t: Tables) -> DataFrame:
    """Flattened history as one array per sample."""
    vector = F.flatten(F.transform(f"history_{WINDOW}", lambda s: F.array(*[s[f] for f in FEATURES])))
    return t.samples.select("site", "class", "period", "year", "month", "target", vector.alias("features"))


def _candidates(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(scores, test predictions) of two climatologies (month; class and month) and ridge, three seeds, all folds.

    A seed leaves out one training year. Ridge is fitted and scored on Gram matrices per (fold, year); its rows are read
    once for those and once for the test predictions.
    """
    rows = cut_lineage(_vectors(t))
    roles = _roles(rows.drop("features"))
    train, rest = roles.where(F.col("role") == "train"), roles.where(F.col("role") != "train")
    e = F.col("y_pred") - F.col("y_true")
    scores, tests = None, None
    for candidate, keys in ((1, ["held_out", "month"]), (2, ["held_out", "class", "month"])):
        means = train.groupBy(*keys).agg(*[F.avg(F.when(F.col("year") != 1994 + s, F.col("target"))).alias(f"_s{s}") for s in SEEDS])
        cells = [F.struct(F.lit(s).alias("seed"), F.col(f"_s{s}").alias("y_pred")) for s in SEEDS]
        mine = rest.join(F.broadcast(means), keys).select(  # folds x classes x months
            "held_out", "role", "site", "year", "month", "period", F.col("target").alias("y_true"), F.inline(F.array(*cells)), F.lit(candidate).alias("candidate")
        ).where(F.col("y_pred").isNotNull())
        score = mine.where(F.col("role") == "val").groupBy("held_out", "candidate", "seed").agg(F.avg(e * e).alias("mse"))
        test = mine.where(F.col("role") == "test").drop("role")
        scores, tests = (score, test) if scores is None else (scores.unionByName(score), tests.unionByName(test))
    by_block = rows.withColumn("fold", F.pmod("site", F.lit(5)).cast("int")).where(F.col("year") < TEST_START)
    grams = gram_table(by_block, "features", "target", ["fold", "year"])
    years = sorted({y for _, y in grams.blocks})
    found, fits = nested_ridge(grams, "fold", "year", FOLDS, {s: [y for y in years if y <= TRAIN_END and y != 1994 + s] for s in SEEDS}, [y for y in years if y > TRAIN_END], ALPHAS)
    ridge = t.spark.createDataFrame([(f, 3, s, mse) for f, s, _, mse in found], "held_out int, candidate int, seed int, mse double")  # folds x seeds
    mine = rows.where(F.col("year") >= TEST_START).withColumn("held_out", F.pmod("site", F.lit(5)).cast("int")).withColumn("y_true", F.col("target")).withColumn("candidate", F.lit(3))
    keep = ["held_out", "site", "year", "month", "period", "y_true", "candidate"]
    return scores.unionByName(ridge), tests.unionByName(predict_levels(mine, "features", "held_out", fits, keep, "seed"))


def _oof(t: Tables) -> DataFrame:
    scores, tests = _candidates(t)
    return op.oof_predict(tests, op.nested_fold_selection(scores, "held_out", "candidate", "mse", 2), "held_out", "candidate")


@query("k03_spatial_folds", with_(T.PANEL + roles_sql("panel"), "SELECT held_out, role, count(*) AS n, count(DISTINCT site) AS sites, min(year) AS first_year, max(year) AS last_year FROM roles WHERE role IS NOT NULL GROUP BY ALL"))
def spatial_folds(t: Tables):
    return _roles(t.panel).groupBy("held_out", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("sites"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


@query("k04_nested_fold_selection", "WITH RECURSIVE " + CANDIDATES + " SELECT * FROM chosen", "mean median", digits=6)
def nested(t: Tables):
    return op.nested_fold_selection(_candidates(t)[0], "held_out", "candidate", "mse", 2)


@query("k04_ridge_penalties", "WITH RECURSIVE " + CANDIDATES + " SELECT held_out, seed, t.alpha, mse FROM tried t JOIN penalty p USING (held_out) WHERE t.alpha = p.alpha", "alpha mse", digits=6)
def penalties(t: Tables):
    rows = _vectors(t).withColumn("fold", F.pmod("site", F.lit(5)).cast("int")).where(F.col("year") < TEST_START)
    grams = gram_table(rows, "features", "target", ["fold", "year"])
    years = sorted({y for _, y in grams.blocks})
    found, _ = nested_ridge(grams, "fold", "year", FOLDS, {s: [y for y in years if y <= TRAIN_END and y != 1994 + s] for s in SEEDS}, [y for y in years if y > TRAIN_END], ALPHAS)
    return t.spark.createDataFrame(found, "held_out int, seed int, alpha double, mse double")


@query("k05_oof_predict", "WITH RECURSIVE " + CANDIDATES + " SELECT * FROM oof", "y_true y_pred", digits=6)
def oof(t: Tables):
    return _oof(t).select("held_out", "arm", "candidate", "seed", "site", "year", "month", "period", "y_true", "y_pred")


@query("k05_oof_violations", "WITH RECURSIVE " + CANDIDATES + """ SELECT 'same_keys' AS "check", a.arm || '|' || p.site || '|' || p.period AS key, 0::DOUBLE AS observed, 1::DOUBLE AS expected FROM samples p, (VALUES ('nested'), ('fixed')) a(arm) WHERE p.year >= 1999
    AND NOT EXISTS (SELECT 1 FROM oof o WHERE o.arm = a.arm AND o.site = p.site AND o.period = p.period)""", "observed expected")
def oof_violations(t: Tables):
    cohort = t.samples.where(F.col("year") >= 1999).select("site", "period")
    return op.oof_violations(_oof(t), cohort, ["site", "period"], ["nested", "fixed"])


@query("k06_cv_bootstrap_compare", with_("RECURSIVE " + CANDIDATES + f""", stats AS (SELECT arm, seed, site, count(*)::DOUBLE AS n, sum(y_true) AS s_y, sum(y_true * y_true) AS s_yy, sum(y_pred) AS s_p, sum(y_pred * y_pred) AS s_pp, sum(y_true * y_pred) AS s_yp,
    sum((y_pred - y_true) * (y_pred - y_true)) AS s_ee, sum(abs(y_pred - y_true)) AS s_ae, sum(y_pred - y_true) AS s_e FROM oof GROUP BY ALL), """ + draws_sql(REPS, "oof") + f""",
  reps AS (SELECT rep, arm, seed, {FROM_SUMS} FROM (SELECT rep, arm, seed, {TOTALS} FROM drawn JOIN stats USING (site) GROUP BY ALL)), mr AS (SELECT rep, arm, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM reps GROUP BY ALL),
  pt AS (SELECT arm, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM (SELECT arm, seed, {METRICS_SQL} FROM oof GROUP BY ALL) GROUP BY arm),
  d AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m} - b.{m} AS x FROM mr a JOIN mr b ON b.rep = a.rep WHERE a.arm = 'nested' AND b.arm = 'fixed'" for m in METRICS)}),
  p AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {m} FROM pt WHERE arm = 'fixed') AS reference, (SELECT {m} FROM pt WHERE arm = 'nested') AS candidate" for m in METRICS)})""",
  """ SELECT metric, reference, candidate, count(*) AS replicates, quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, quantile_cont(x, 0.025) <= 0 AND quantile_cont(x, 0.975) >= 0 AS includes_zero,
    candidate - reference AS difference, 100 * (candidate - reference) / nullif(abs(reference), 0) AS relative_percent FROM p JOIN d USING (metric) GROUP BY ALL"""), "reference candidate lower upper difference relative_percent", digits=6)
def cv_compare(t: Tables):
    return op.cv_bootstrap_compare(_oof(t), "site", "fixed", "nested", REPS, SEED)


# --- linear and forest grids ----------------------------------------------------------------

def _train_val(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = cut_lineage(_vectors(t))
    return v.where(F.col("year") <= TRAIN_END), v.where(F.col("year").between(TRAIN_END + 1, TEST_START - 1))


GRID_SQL = VECTORS + f""", ranked AS (SELECT site, period, target, v, CASE WHEN year <= {TRAIN_END} THEN 'train' WHEN year < {TEST_START} THEN 'val' ELSE 'test' END AS role FROM vectors),
  {gram_sql("parts", "role", "(SELECT role, v FROM ranked WHERE role <> 'test')")},
  arms AS (SELECT 'train' AS arm, i, j, v FROM parts WHERE role = 'train' UNION ALL SELECT 'train_val', i, j, sum(v) FROM parts GROUP BY i, j),
  {ridge_sql("fits", "arm", "arms", N_FEATURES)},
  grid AS (SELECT *, row_number() OVER (ORDER BY rmse, mae, candidate) = 1 AS selected FROM (
    SELECT list_position({ALPHAS}::DOUBLE[], alpha)::INT AS candidate, alpha, {METRICS_SQL} FROM (SELECT alpha, target AS y_true, {PREDICTED} AS y_pred FROM ranked, fits WHERE role = 'val' AND arm = 'train') GROUP BY alpha))"""


@query("k01_ridge_grid", "WITH RECURSIVE " + GRID_SQL + " SELECT candidate, n, rmse, mae, r2, bias, pearson_r, alpha, selected FROM grid", "rmse mae r2 bias pearson_r alpha", digits=6)
def ridge_grid(t: Tables):
    train, val = _train_val(t)
    return op.ridge_grid(train, val, "features", "target", ALPHAS)


@query("k01_ridge_predict", "WITH RECURSIVE " + GRID_SQL + f""" SELECT site, period, arm, target AS y_true, {PREDICTED} AS y_pred, f.alpha FROM ranked, fits f JOIN grid g ON g.alpha = f.alpha AND selected WHERE role = 'test'""", "y_true y_pred alpha", digits=6)
def ridge_predict(t: Tables):
    role = F.when(F.col("year") <= TRAIN_END, "train").when(F.col("year") < TEST_START, "val").otherwise("test")
    return op.ridge_refit(cut_lineage(_vectors(t)).withColumn("role", role), "role", "features", "target", ALPHAS, ["site", "period"])


@query("k02_random_forest_grid")
def forest_grid(t: Tables):
    train, val = _train_val(t)
    return op.random_forest_grid(train, val, "features", "target", TREES, [None, 20, 40], [1, 3], keys=["site", "period"])


@query("k14_prediction_frame", with_(T.PANEL, f"""SELECT p.site, p.period, p.target AS y_true, c.y_pred, 'class_month' AS model, 42 AS seed, 1.0::DOUBLE AS alpha FROM panel p LEFT JOIN
  (SELECT class, month, avg(target) AS y_pred FROM panel WHERE year <= {TRAIN_END} GROUP BY ALL) c ON c.class = p.class AND c.month = p.month WHERE p.year >= {TEST_START}"""), "y_true y_pred alpha")
def prediction_frame(t: Tables):
    test = t.panel.where(F.col("year") >= TEST_START)
    means = t.panel.where(F.col("year") <= TRAIN_END).groupBy("class", "month").agg(F.avg("target").alias("y_pred"))
    preds = test.select("site", "period", "class", "month").join(F.broadcast(means), ["class", "month"])  # classes x months
    return op.prediction_frame(test.withColumnRenamed("target", "y_true"), preds, ["site", "period"], "class_month", 42, {"alpha": 1.0})


# --- additive surface -----------------------------------------------------------------------

def _analysis(t: Tables) -> DataFrame:
    """The analysis master, materialised once: every fit reads it several times."""
    flags = ["primary", "all12", "season", "qa1", "qa2", "dayweighted", "median_response", "raw_exposure", "cold_snow"]
    fields = ["net_anomaly_mean", "net_anomaly_median", "dw_anomaly", "water_rank", "energy_rank", "water_anomaly_mean", "energy_anomaly_mean", "load_anomaly_mean", *SPEC.controls]
    return cut_lineage(t.flagged.select("site", "period", "year", "month", *fields, *[f"eligible_{f}" for f in flags]))


def _primary(t: Tables) -> DataFrame:
    return _analysis(t).where(F.col("eligible_primary") == 1)


# --- the additive surface in SQL: whitened rows, sums per site, elimination -----------------------

def hats_sql(column: str, knots: tuple[float, ...]) -> list[str]:
    v = f"least(greatest({column}, {knots[0]}::DOUBLE), {knots[-1]}::DOUBLE)"
    out = []
    for i, k in enumerate(knots):
        sides = [f"({v} - {knots[i - 1]}::DOUBLE) / {k - knots[i - 1]}::DOUBLE"] if i else []
        sides += [f"({knots[i + 1]}::DOUBLE - {v}) / {knots[i + 1] - k}::DOUBLE"] if i < len(knots) - 1 else []
        out.append(f"greatest({sides[0] if len(sides) == 1 else 'least(' + ', '.join(sides) + ')'}, 0::DOUBLE)")
    return out


def design_sql(spec: op.AdditiveSpec) -> str:
    cells = [f"{a} * {b}" for a in hats_sql(spec.x, spec.knots) for b in hats_sql(spec.y, spec.knots_of_y)]
    for c, knots in spec.controls.items():
        cells += hats_sql(c, knots)[1:]
    cells += [f"(month = {m})::INT::DOUBLE" for m in spec.months[1:]] + [f"(year = {y})::INT::DOUBLE" for y in spec.years[1:]]
    return "[" + ", ".join(cells) + "]"


def surface_sql(name: str, source: str, rho: str, spec: op.AdditiveSpec = SPEC) -> str:
    """`{name}` (g, x = coefficients) and `{name}_e` (g, site, uu, e = sums with the intercept) of the fits of `source` (g, site, period, y, x) per g."""
    p, pen = spec.width, f"{spec.site_ridge}::DOUBLE"
    return f"""{name}_l AS MATERIALIZED (SELECT *, {rho} AS rho, sqrt(1 - {rho} * {rho}) AS scale, list_concat(x, [y]) AS v, lag(list_concat(x, [y])) OVER w AS pv, coalesce(period - lag(period) OVER w > 1, true) AS start FROM {source} WINDOW w AS (PARTITION BY g, site ORDER BY period)),
  {name}_w AS MATERIALIZED (SELECT g, site, CASE WHEN start THEN v ELSE list_transform(v, lambda a, i: (a - rho * pv[i]) / scale) END AS v, CASE WHEN start THEN 1::DOUBLE ELSE (1 - rho) / scale END AS u FROM {name}_l),
  {name}_e AS MATERIALIZED (SELECT g, site, max(uu) AS uu, list(e ORDER BY i) AS e FROM (SELECT g, site, i, sum(v[i] * u) AS e, sum(u * u) AS uu FROM {name}_w, range(1, {p + 2}) r(i) GROUP BY ALL) GROUP BY ALL),
  {name}_c AS (SELECT g, i, j, sum(c) AS c FROM (SELECT g, i, j, sum(v[i] * v[j]) AS c FROM {name}_w, range(1, {p + 1}) a(i), range(1, {p + 2}) b(j) GROUP BY ALL
    UNION ALL SELECT g, i, j, -sum(e[i] * e[j] / (uu + {pen})) FROM {name}_e, range(1, {p + 1}) a(i), range(1, {p + 2}) b(j) GROUP BY ALL) GROUP BY ALL),
  {name}_m AS (SELECT g, list(r ORDER BY i) AS m FROM (SELECT g, i, list(c + CASE WHEN i = j THEN {spec.ridge}::DOUBLE ELSE 0 END ORDER BY j) AS r FROM {name}_c GROUP BY ALL) GROUP BY ALL),
  {solve_sql(name, "g", name + "_m", p)}"""


#: The primary rows, the independent fit with its residuals, and the autocorrelation they have.
SURFACE = "RECURSIVE " + T.FLAGGED + f""", base AS MATERIALIZED (SELECT 0 AS g, site, period, year, {SPEC.response}::DOUBLE AS y, {design_sql(SPEC)} AS x FROM flagged WHERE eligible_primary = 1),
  {surface_sql("fit0", "base", "0::DOUBLE")},
  fitted AS (SELECT b.site, b.period, b.y, list_inner_product(b.x, f.x) + (e.e[{SPEC.width + 1}] - list_inner_product(e.e[1:{SPEC.width}], f.x)) / (e.uu + {SPEC.site_ridge}::DOUBLE) AS fitted,
    (e.e[{SPEC.width + 1}] - list_inner_product(e.e[1:{SPEC.width}], f.x)) / (e.uu + {SPEC.site_ridge}::DOUBLE) AS site_effect FROM base b JOIN fit0_e e ON e.site = b.site, fit0 f),
  pairs AS (SELECT y - fitted AS now, lag(y - fitted) OVER w AS before, period - lag(period) OVER w AS gap FROM fitted WINDOW w AS (PARTITION BY site ORDER BY period)),
  auto AS MATERIALIZED (SELECT corr(before, now) AS rho FROM pairs WHERE gap = 1), {surface_sql("fit1", "base", "(SELECT rho FROM auto)")}"""
_M = op.contrast_matrix(SPEC)
_ABOUT = [(n, {"x": SPEC.x, "y": SPEC.y}[axis], e) for n, _, _, axis, e in op.CONTRASTS] + [(op.CONTRAST_NAMES[-1], SPEC.y, False)]
LOYO = SURFACE + f""", copies AS MATERIALIZED (SELECT o.y AS g, b.site, b.period, b.y, b.x FROM base b, (SELECT unnest({list(SPEC.years)}) AS y) o WHERE b.year <> o.y), {surface_sql("fity", "copies", "(SELECT rho FROM auto)")},
  main AS (SELECT list_inner_product(x, {_M[-1].tolist()}::DOUBLE[]) AS m FROM fit1)"""


@query("k07_additive_surface_fit", with_(SURFACE, "SELECT site, period, fitted, y - fitted AS residual, site_effect FROM fitted"), "fitted residual site_effect", digits=6)
def surface_fit(t: Tables):
    rows = _primary(t)
    fit = op.additive_surface_fit(rows, SPEC)
    return op.residuals(rows, fit).select("site", "period", "fitted", "residual", "site_effect")


@query("k08_estimate_rho")
def rho(t: Tables):
    return op.estimate_rho(_primary(t), SPEC)[1]


def _fitted(t: Tables) -> tuple[DataFrame, op.AdditiveFit]:
    """The primary rows and the model with its estimated autocorrelation."""
    rows = _primary(t)
    return rows, op.fit_with_rho(rows, SPEC)[0]


def _attempts(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = _primary(t)
    fit, moments = op.fit_with_rho(rows, SPEC)
    return op.bootstrap_attempts(rows, SPEC, fit.rho, SUCCESSES, ATTEMPTS, SEED, moments)


@query("k09_surface_contrasts", with_(SURFACE, " UNION ALL ".join(f"SELECT 'all' AS analysis, '{n}' AS contrast, '{v}' AS variable, {e} AS exploratory, list_inner_product(x, {row.tolist()}::DOUBLE[]) AS estimate FROM fit1" for (n, v, e), row in zip(_ABOUT, _M))), "estimate", digits=6)
def contrasts(t: Tables):
    return op.surface_contrasts(t.spark, _fitted(t)[1])


@query("k09_contrast_invariance")
def invariance(t: Tables):
    return op.contrast_invariance(*_fitted(t))


@query("k10_contrast_bootstrap")
def contrast_bootstrap(t: Tables):
    return _attempts(t)[0]


@query("k10_bootstrap_ledger")
def bootstrap_ledger(t: Tables):
    return _attempts(t)[1]


@query("k11_surface_grid_predict")
def surface_grid(t: Tables):
    return op.surface_grid_predict(*_fitted(t), 80)


@query("k12_loyo_refit", with_(LOYO, f"""SELECT g::VARCHAR AS omitted_year, 'A_minus_B' AS contrast, '{SPEC.y}' AS variable, false AS exploratory, estimate, sign(estimate) = sign(m) AS same_sign, (estimate - m) / nullif(abs(m), 0) AS relative_change
  FROM (SELECT g, list_inner_product(x, {_M[-1].tolist()}::DOUBLE[]) AS estimate FROM fity), main"""), "estimate relative_change", digits=6)
def loyo(t: Tables):
    rows, fit = _fitted(t)
    return op.loyo_refit(rows, SPEC, fit.rho, list(SPEC.years), fit)


def _analyses(rows: DataFrame) -> list[op.Analysis]:
    """Every sensitivity analysis with its own rows, response, exposures and covariates.

    The raw exposures are compared at the values that have the main positions' ranks among the primary rows.
    """
    primary = rows.where(F.col("eligible_primary") == 1)
    at = [exact_quantiles(primary, c, q, inverse_cdf=True).first() for c, q in (("water_anomaly_mean", {"low": 0.05, "mid": 0.5, "high": 0.75, "top": 0.95}), ("energy_anomaly_mean", {"low": 0.05, "quarter": 0.25, "mid": 0.5, "top": 0.95}))]
    w, e = at
    raw = replace(SPEC, x="water_anomaly_mean", y="energy_anomaly_mean", knots=(w["low"], w["mid"], w["top"]), y_knots=(e["low"], e["mid"], e["top"]), a=(w["high"], e["quarter"]), b=(w["high"], e["mid"]))
    wide = {"load_anomaly_mean": (-0.5, 0.0, 0.5)}
    more = {**wide, "energy_anomaly_mean": (-0.5, 0.0, 0.5), "water_anomaly_mean": (-2.0, 0.0, 2.0)}
    specs = {
        "primary": SPEC, "all12": SPEC, "season": SPEC, "qa1": SPEC, "qa2": SPEC, "cold_snow": SPEC, "dayweighted": replace(SPEC, response="dw_anomaly"),
        "median_response": replace(SPEC, response="net_anomaly_median"), "raw_exposure": raw,
    }
    out = [op.Analysis(k, F.col(f"eligible_{k}") == 1, spec) for k, spec in specs.items()]
    out += [op.Analysis(k, F.col("eligible_primary") == 1, replace(SPEC, controls={**SPEC.controls, **added})) for k, added in (("model2", wide), ("model3", more))]
    return out


@query("k13_sensitivity_suite")
def sensitivity(t: Tables):
    rows = _analysis(t)
    rho = op.fit_with_rho(rows.where(F.col("eligible_primary") == 1), SPEC)[0].rho
    return op.sensitivity_suite(rows, _analyses(rows), rho)


@query("k15_reference_row", "WITH " + T.FLAGGED + " SELECT min(month) AS month, min(year) AS year, min(site) AS site, " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}" for c in SPEC.controls)
       + ", 0.75::DOUBLE AS water_rank, 0.25::DOUBLE AS energy_rank FROM flagged WHERE eligible_primary = 1", " ".join(SPEC.controls))
def reference(t: Tables):
    return op.reference_row(_primary(t), SPEC, 0.25)


@query("k16_fit_health")
def health(t: Tables):
    return op.fit_health(*_fitted(t))
