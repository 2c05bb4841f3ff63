"""Panels, predictions, composites, attributions and manifests derived from the driver tables.

Each table exists twice: as a DataFrame and as a SQL common table expression with the same rows.
A site is a supplier, a period is the ship month, a class is the supplier's region. Money is scaled
by odd constants so that no derived value falls on a rounding tie.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import index_month, index_year, month_index
from panelwright.operators import attribution, baselines, temporal
from panelwright.session import cut_lineage
from panelwright.sources.composites import monthly_flag_any

TRAIN_END, VALIDATION_END, TEST_START = 1998, 1999, 2000
MONEY, QUANTITY, SHARE, NET_LEVEL = 997300000.0, 97.0, 9.973, 3.0
FEATURES = ["water", "energy", "heat", "load", "peak"]
GROUPS = {"Hydrologic": ["water"], "Energy": ["energy"], "Thermal": ["heat"], "Activity": ["load", "peak"]}
WINDOW = 6
RUNS = ["r1", "r2", "r3"]
DRAWS = ["E0", "E1", "E2", "E3"]
CENTERS = [("A", 0.75, 0.25), ("B", 0.75, 0.50)]
SEED = 20240724
MODEL_FIELDS = ["net_anomaly_mean", "water_rank", "energy_rank", "water_ante3", "energy_ante3", "heat_lag1", "heat_anomaly_mean", "load_anomaly_mean"]


def _whole(value: Column) -> Column:
    """Nearest integer of a non-negative amount, in primitive arithmetic."""
    return F.floor(value + F.lit(0.5))


def coefficient(run: int, feature: int, lag: int) -> float:
    """Coefficient of the linear model behind the attribution tables."""
    return float(((feature * 7 + lag * 3 + run * 5) % 11) - 5) / float(lag + run)


class Tables:
    """DataFrames of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._scans: dict[str, DataFrame] = {}

    def raw(self, name: str, *columns: str) -> DataFrame:
        """Scan of a driver table."""
        if name not in self._scans:
            self._scans[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        df = self._scans[name]
        return df.select(*columns) if columns else df

    @cached_property
    def sites(self) -> DataFrame:
        """(site, class): one row per supplier."""
        nation = self.raw("nation", "n_nationkey", "n_regionkey")
        supplier = self.raw("supplier", "s_suppkey", "s_nationkey")
        return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("site"), F.col("n_regionkey").alias("class")
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Lines combine per (site, month) before anything is joined; sums are exact integers.

        Materialised once: most queries read it several times, and it is far smaller than the lines.
        """
        money = _whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000)
        tax = _whole(F.col("l_extendedprice") * F.col("l_tax") * 10000)
        cells = (
            self.raw("lineitem", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
            .groupBy(F.col("l_suppkey").alias("site"), month_index(F.year("l_shipdate"), F.month("l_shipdate")).alias("period"))
            .agg(
                F.sum(money).alias("_m"), F.sum(tax).alias("_t"), F.sum(F.col("l_quantity").cast("long")).alias("_q"),
                F.sum(_whole(F.col("l_discount") * 100)).alias("_d"), F.count(F.lit(1)).alias("_n"), F.max("l_quantity").alias("peak"),
            )
        )
        target = F.col("_m") / F.lit(MONEY)
        return cut_lineage(cells.join(self.sites, "site").select(
            "site", "class", "period", index_year("period").alias("year"), index_month("period").alias("month"), target.alias("target"),
            (target - F.lit(NET_LEVEL)).alias("net"), (F.col("_q") / F.lit(QUANTITY)).alias("water"), (F.col("_t") / F.lit(MONEY / 10)).alias("energy"),
            (F.col("_d") / F.col("_n") / F.lit(SHARE)).alias("heat"), F.col("_n").cast("double").alias("load"), "peak",
        ))

    def _bound(self, how) -> Column:
        return self.panel.select(how("period")).scalar()

    @cached_property
    def lagged(self) -> DataFrame:
        """Every site with every month of the calendar, missing cells with null measures, and the lagged inputs.

        One layout by site serves the calendar and every window over it; written once, it is what baselines, ranks and
        the evaluation rows read.
        """
        keys, time = ["site"], "period"
        measures = self.panel.drop("year", "month")
        filled = temporal.fill_calendar(measures, keys, time, self._bound(F.min), self._bound(F.max), constant=["class"])
        full = filled.withColumn("year", index_year(time)).withColumn("month", index_month(time))
        full = temporal.positional_lag(full, keys, time, {"heat": "heat_lag1"})
        full = temporal.antecedent(full, keys, time, "water", "water_ante3", 3, "sum")
        return cut_lineage(temporal.antecedent(full, keys, time, "energy", "energy_ante3", 3, "mean"))

    @cached_property
    def dense(self) -> DataFrame:
        """The whole calendar without lags."""
        return self.lagged.drop("heat_lag1", "water_ante3", "energy_ante3")

    @cached_property
    def invalid(self) -> DataFrame:
        """Panel cells taken as invalid inputs: a single line in the month."""
        return self.panel.where(F.col("load") == 1).select("site", "period")

    @cached_property
    def predictions(self) -> DataFrame:
        """Two climatology models, three seeds (each leaves one training year out), all test rows.

        A row whose cell has no training year keeps a null prediction: metrics count complete pairs only.
        """
        train = self.panel.where(F.col("year") <= TRAIN_END)
        seeds = {s: F.avg(F.when(F.col("year") != 1994 + s, F.col("target"))) for s in (1, 2, 3)}
        by_site = train.groupBy("site", "month").agg(*[a.alias(f"_a{s}") for s, a in seeds.items()])
        by_month = train.groupBy("month").agg(*[a.alias(f"_b{s}") for s, a in seeds.items()])
        test = self.panel.where(F.col("year") >= TEST_START).join(by_site, ["site", "month"], "left").join(F.broadcast(by_month), "month", "left")  # twelve rows
        cells = [
            F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.col(f"{p}{s}").alias("y_pred"))
            for m, p in (("site_month", "_a"), ("month", "_b")) for s in seeds
        ]
        fold = F.pmod(F.col("site"), F.lit(5)).cast("int").alias("fold")
        return test.select("site", "class", fold, "year", "month", "period", F.col("target").alias("y_true"), F.inline(F.array(*cells)))

    @cached_property
    def composites(self) -> DataFrame:
        """8-day records restarting each January: value, usable flag, QA bits."""
        money = _whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000)
        day = F.to_date("l_shipdate")
        start = F.date_add(F.trunc(day, "YEAR"), (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))
        lines = self.raw("lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_returnflag", "l_orderkey", "l_linenumber")
        return cut_lineage(lines.groupBy(F.col("l_suppkey").alias("site"), start.alias("start")).agg(
            (F.sum(money) / F.lit(MONEY)).alias("value"), (1 - F.max((F.col("l_returnflag") == "R").cast("int"))).alias("usable"),
            F.pmod(F.sum("l_orderkey") * 31 + F.sum("l_linenumber"), F.lit(20000)).cast("int").alias("qa"),
        ))

    @cached_property
    def samples(self) -> DataFrame:
        """Panel rows with a complete history of WINDOW months, with the history array."""
        return cut_lineage(temporal.history_windows(self.panel, ["site"], "period", FEATURES, "target", [WINDOW]))

    def inputs_of(self, samples: DataFrame) -> DataFrame:
        """(sample, lag, feature, value) of some of the samples."""
        return temporal.explode_history(samples, f"history_{WINDOW}", WINDOW, FEATURES, ["site", "class", "period", "year", "month"])

    @cached_property
    def features_long(self) -> DataFrame:
        return self.inputs_of(self.samples)

    @cached_property
    def attributions(self) -> DataFrame:
        """Three runs of exact linear attributions over all samples."""
        return self.attributions_of(self.samples)

    def attributions_of(self, samples: DataFrame) -> DataFrame:
        """The attributions of some of the samples; the background is that of all."""
        return attribution.linear_attribution(self.inputs_of(samples), self.background, self.coefficients, ["site", "class", "period"], keep_value=True)

    @cached_property
    def nested_attributions(self) -> DataFrame:
        """The same attributions with the lags of a run, sample and feature in one row."""
        return attribution.nested_attribution(self.samples, f"history_{WINDOW}", WINDOW, FEATURES, self.background, self.coefficients, ["site", "class", "period"])

    @property
    def background(self) -> DataFrame:
        return self.features_long.where(F.col("year") <= TRAIN_END)

    @property
    def coefficients(self) -> DataFrame:
        rows = ", ".join(
            f"('{r}', {lag}, '{f}', {coefficient(ri, fi, lag)!r}D)"
            for ri, r in enumerate(RUNS, 1) for fi, f in enumerate(FEATURES, 1) for lag in range(1, WINDOW + 1)
        )
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(run, lag, feature, coef)")

    @cached_property
    def manifest(self) -> DataFrame:
        """Sampling draws: the site-months that occur in a band of order line numbers."""
        draw = F.concat(F.lit("E"), F.floor((F.col("l_linenumber") - 1) / 2).cast("string"))
        keys = self.raw("lineitem", "l_suppkey", "l_shipdate", "l_linenumber").select(
            draw.alias("draw"), F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
        )
        return keys.distinct().join(self.sites, "site")

    @cached_property
    def monthly_qa(self) -> DataFrame:
        stamped = self.composites.withColumn("year", F.year("start")).withColumn("month", F.month("start"))
        return baselines.monthly_qa(stamped, ["site", "year", "month"], "usable")

    @cached_property
    def dayweighted(self) -> DataFrame:
        monthly = temporal.allocate_days_to_months(self.composites, ["site"], "start", "value", "dw")
        shifted = monthly.withColumn("dw", F.col("dw") - F.lit(NET_LEVEL))
        return baselines.dayweighted_target(shifted, ["site"], "dw", (0, TRAIN_END), (TEST_START, 9999))

    @cached_property
    def snow(self) -> DataFrame:
        return monthly_flag_any(self.composites, ["site"], "start", "qa")

    @cached_property
    def climatology(self) -> DataFrame:
        return baselines.climatology(self.dense, ["site", "month"], ["net", "water", "energy", "heat", "load"], 0, TRAIN_END)

    @cached_property
    def master(self) -> DataFrame:
        """Evaluation rows with lags, baselines, anomalies, ranks and activity."""
        history = self.dense.where(F.col("year") <= TRAIN_END)
        ev = self.lagged.where((F.col("year") >= TEST_START) & F.col("net").isNotNull())
        ev = baselines.anomaly(ev, self.climatology, ["site", "month"], ["net", "water", "energy", "heat", "load"])
        ev = baselines.midrank_vs_history(ev, history, ["site", "month"], ["water", "energy"])
        ev = ev.withColumn("active", baselines.historically_active("net_median").cast("int"))
        return ev.select(
            "site", "class", "year", "month", "period", "net", "water", "energy", "heat", "load", "net_mean", "net_median", "net_anomaly_mean",
            (F.col("net") - F.col("net_median")).alias("net_anomaly_median"), "water_anomaly_mean", "energy_anomaly_mean", "heat_anomaly_mean",
            "load_anomaly_mean", "active", "water_rank", "energy_rank", "water_ante3", "energy_ante3", "heat_lag1",
        )

    @cached_property
    def flagged(self) -> DataFrame:
        """Master with QA, day-weighted and snow columns and all eligibility flags."""
        keys = ["site", "year", "month"]
        dw = self.dayweighted.select(*keys, F.col("dw_anomaly_mean").alias("dw_anomaly"), F.col("dayweighted_active").alias("dw_active"))
        snow = baselines.snow_state(self.snow, "any_flag", "record_count").select(*keys, "snow", "snow_known")
        joined = self.master.join(self.monthly_qa.select(*keys, "good_fraction"), keys, "left").join(dw, keys, "left").join(snow, keys, "left")
        return baselines.eligibility_flags(
            joined, MODEL_FIELDS, "active", good_fraction="good_fraction", dayweighted=("dw_active", "dw_anomaly"), cold=("heat", "snow", "snow_known")
        )


# --- the same tables in SQL -----------------------------------------------------------------

_MONEY = "sum(round(l_extendedprice * (1 - l_discount) * 10000)::BIGINT)::DOUBLE"

SITES = """sites AS (
  SELECT s_suppkey AS site, n_regionkey AS class FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PANEL = SITES + f""", cells AS (
  SELECT l_suppkey AS site, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS period, {_MONEY} AS m,
    sum(round(l_extendedprice * l_tax * 10000)::BIGINT)::DOUBLE AS t, sum(l_quantity::BIGINT)::DOUBLE AS q,
    sum(round(l_discount * 100)::BIGINT)::DOUBLE AS d, count(*)::DOUBLE AS n, max(l_quantity) AS peak
  FROM lineitem GROUP BY ALL), panel AS (
  SELECT site, class, period, (period // 12)::INT AS year, (period % 12 + 1)::INT AS month, m / {MONEY}::DOUBLE AS target,
    m / {MONEY}::DOUBLE - {NET_LEVEL}::DOUBLE AS net, q / {QUANTITY}::DOUBLE AS water, t / {MONEY / 10}::DOUBLE AS energy,
    d / n / {SHARE}::DOUBLE AS heat, n AS load, peak
  FROM cells JOIN sites USING (site))"""

DENSE = PANEL + """, spine AS (
  SELECT site, class, unnest(range(lo, hi + 1))::INT AS period
  FROM (SELECT DISTINCT site, class FROM panel), (SELECT min(period) AS lo, max(period) AS hi FROM panel)), dense AS (
  SELECT s.site, s.class, s.period, (s.period // 12)::INT AS year, (s.period % 12 + 1)::INT AS month,
    p.target, p.net, p.water, p.energy, p.heat, p.load, p.peak
  FROM spine s LEFT JOIN panel p ON p.site = s.site AND p.period = s.period)"""

INVALID = "invalid AS (SELECT site, period FROM panel WHERE load = 1)"


def excluded(window: int) -> str:
    return f"excluded AS (SELECT DISTINCT site, (period + k)::INT AS period FROM invalid, range(1, {window} + 1) r(k))"


PREDICTIONS = PANEL + f""", seeds AS (SELECT unnest([1, 2, 3])::INT AS seed),
  ca AS (SELECT seed, site, month, avg(target) FILTER (WHERE year <> 1994 + seed) AS y_pred FROM panel, seeds WHERE year <= {TRAIN_END} GROUP BY ALL),
  cb AS (SELECT seed, month, avg(target) FILTER (WHERE year <> 1994 + seed) AS y_pred FROM panel, seeds WHERE year <= {TRAIN_END} GROUP BY ALL),
  test AS (SELECT p.*, seed FROM panel p, seeds WHERE year >= {TEST_START}),
  predictions AS (
  SELECT 'site_month' AS model, t.seed, t.site, class, (t.site % 5)::INT AS fold, year, t.month, period, target AS y_true, y_pred
  FROM test t LEFT JOIN ca ON ca.seed = t.seed AND ca.site = t.site AND ca.month = t.month
  UNION ALL
  SELECT 'month', t.seed, t.site, class, (t.site % 5)::INT, year, t.month, period, target, y_pred
  FROM test t LEFT JOIN cb ON cb.seed = t.seed AND cb.month = t.month)"""

_PAIRED = "FILTER (WHERE y_pred IS NOT NULL)"
METRICS_SQL = f"""count(y_pred) AS n, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, avg(abs(y_pred - y_true)) AS mae,
  CASE WHEN var_pop(y_true) {_PAIRED} > 0 THEN 1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) {_PAIRED} * count(y_pred)) END AS r2,
  avg(y_pred - y_true) AS bias, CASE WHEN var_pop(y_true) {_PAIRED} > 0 AND var_pop(y_pred) > 0 THEN corr(y_true, y_pred) END AS pearson_r"""


def sums_sql(center: float = 0.0) -> str:
    """The nine sums over pairs with a prediction, as the operator forms them."""
    y, p = f"(y_true - {center}::DOUBLE)", f"(y_pred - {center}::DOUBLE)"
    cells = {"s_y": y, "s_yy": f"{y} * {y}", "s_p": p, "s_pp": f"{p} * {p}", "s_yp": f"{y} * {p}", "s_ee": "(y_pred - y_true) * (y_pred - y_true)", "s_ae": "abs(y_pred - y_true)", "s_e": "y_pred - y_true"}
    return "count(y_pred)::DOUBLE AS n, " + ", ".join(f"coalesce(sum({v}) {_PAIRED}, 0) AS {k}" for k, v in cells.items())


METRIC_NAMES = ["rmse", "mae", "r2", "bias", "pearson_r"]
MEAN_SD_SQL = "count(*) FILTER (WHERE n > 0) AS n_seeds, max(n) AS records_per_seed, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd" for m in METRIC_NAMES)
MEAN_SD_DOUBLES = " ".join(f"{m}_mean {m}_sd" for m in METRIC_NAMES)

COMPOSITES = f"""composites AS (
  SELECT l_suppkey AS site, (date_trunc('year', l_shipdate)::DATE + (((dayofyear(l_shipdate) - 1) // 8) * 8)::INT) AS start,
    {_MONEY} / {MONEY}::DOUBLE AS value, 1 - max((l_returnflag = 'R')::INT) AS usable,
    ((sum(l_orderkey)::BIGINT * 31 + sum(l_linenumber)::BIGINT) % 20000)::INT AS qa
  FROM lineitem GROUP BY ALL)"""

SAMPLES = PANEL + f""", samples AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY site ORDER BY period RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS k FROM panel)
  WHERE k = {WINDOW})"""

FEATURES_LONG = SAMPLES + """, feats AS (""" + " UNION ALL ".join(
    f"SELECT site, period, '{f}' AS feature, {i} AS fi, {f} AS value FROM panel" for i, f in enumerate(FEATURES, 1)
) + f"""), features_long AS (
  SELECT s.site, s.class, s.period, s.year, s.month, r.lag::INT AS lag, f.feature, f.fi, f.value
  FROM samples s, range(1, {WINDOW} + 1) r(lag), feats f WHERE f.site = s.site AND f.period = s.period - r.lag)"""

ATTRIBUTIONS = FEATURES_LONG + f""", background AS (
  SELECT lag, feature, avg(value) AS mean FROM features_long WHERE year <= {TRAIN_END} GROUP BY ALL), attributions AS (
  SELECT 'r' || r.run AS run, f.site, f.class, f.period, f.lag, f.feature,
    ((((fi * 7 + f.lag * 3 + r.run * 5) % 11) - 5)::DOUBLE / (f.lag + r.run)::DOUBLE) * (f.value - b.mean) AS shap
  FROM features_long f JOIN background b ON b.lag = f.lag AND b.feature = f.feature, range(1, {len(RUNS)} + 1) r(run))"""

MANIFEST = SITES + """, manifest AS (
  SELECT DISTINCT 'E' || ((l_linenumber - 1) // 2) AS draw, l_suppkey AS site, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, class
  FROM lineitem JOIN sites ON sites.site = l_suppkey)"""

CLIMATOLOGY = DENSE + ", clim AS (SELECT site, month, " + ", ".join(
    f"avg({c}) AS {c}_mean, quantile_cont({c}, 0.5) AS {c}_median, count({c}) AS {c}_n" for c in ["net", "water", "energy", "heat", "load"]
) + f" FROM dense WHERE year <= {TRAIN_END} GROUP BY ALL)"

MASTER = CLIMATOLOGY + f""", lagged AS (
  SELECT *, lag(heat) OVER w AS heat_lag1, lag(water, 1) OVER w + lag(water, 2) OVER w + lag(water, 3) OVER w AS water_ante3,
    (lag(energy, 1) OVER w + lag(energy, 2) OVER w + lag(energy, 3) OVER w) / 3 AS energy_ante3
  FROM dense WINDOW w AS (PARTITION BY site ORDER BY period)),
  ranks AS (SELECT e.site, e.period,
      (count(*) FILTER (WHERE h.water < e.water) + (count(*) FILTER (WHERE h.water = e.water) + 1) * 0.5::DOUBLE) / (count(h.water) + 1) AS water_rank,
      (count(*) FILTER (WHERE h.energy < e.energy) + (count(*) FILTER (WHERE h.energy = e.energy) + 1) * 0.5::DOUBLE) / (count(h.energy) + 1) AS energy_rank
    FROM panel e JOIN panel h ON h.site = e.site AND h.month = e.month AND h.year <= {TRAIN_END} WHERE e.year >= {TEST_START} GROUP BY ALL),
  master AS (
  SELECT l.site, l.class, l.year, l.month, l.period, l.net, l.water, l.energy, l.heat, l.load, net_mean, net_median, l.net - net_mean AS net_anomaly_mean,
    l.net - net_median AS net_anomaly_median, l.water - water_mean AS water_anomaly_mean, l.energy - energy_mean AS energy_anomaly_mean,
    l.heat - heat_mean AS heat_anomaly_mean, l.load - load_mean AS load_anomaly_mean, coalesce(net_median > 0, false)::INT AS active,
    water_rank, energy_rank, water_ante3, energy_ante3, heat_lag1
  FROM lagged l LEFT JOIN clim c ON c.site = l.site AND c.month = l.month LEFT JOIN ranks r ON r.site = l.site AND r.period = l.period
  WHERE l.year >= {TEST_START} AND l.net IS NOT NULL)"""

MASTER_DOUBLES = (
    "net water energy heat load net_mean net_median net_anomaly_mean net_anomaly_median water_anomaly_mean energy_anomaly_mean "
    "heat_anomaly_mean load_anomaly_mean water_rank energy_rank water_ante3 energy_ante3 heat_lag1"
)

DAYWEIGHTED = COMPOSITES + f""", starts AS (
  SELECT start, coalesce(CASE WHEN datediff('day', start, nxt) <= 8 THEN nxt END, start + 8)::DATE AS stop
  FROM (SELECT start, lead(start) OVER (ORDER BY start) AS nxt FROM (SELECT DISTINCT start FROM composites))),
  allocated AS (
  SELECT site, year(m)::INT AS year, month(m)::INT AS month,
    sum(value * datediff('day', greatest(start, m::DATE), least(stop, (m + INTERVAL 1 MONTH)::DATE)) / datediff('day', start, stop)) AS dw
  FROM (SELECT c.site, c.value, s.start, s.stop, unnest(generate_series(date_trunc('month', s.start), date_trunc('month', s.stop - 1), INTERVAL 1 MONTH)) AS m
        FROM composites c JOIN starts s ON s.start = c.start WHERE c.value IS NOT NULL) GROUP BY ALL),
  dwm AS (SELECT site, year, month, dw - {NET_LEVEL}::DOUBLE AS dw FROM allocated),
  dwc AS (SELECT site, month, avg(dw) AS dw_mean, quantile_cont(dw, 0.5) AS dw_median FROM dwm WHERE year <= {TRAIN_END} GROUP BY ALL),
  dayweighted AS (
  SELECT d.site, d.month, d.year, d.dw, dw_mean, dw_median, d.dw - dw_mean AS dw_anomaly_mean, coalesce(dw_median > 0, false)::INT AS dayweighted_active
  FROM dwm d LEFT JOIN dwc c ON c.site = d.site AND c.month = d.month WHERE d.year >= {TEST_START})"""

MONTHLY_QA = """monthly_qa AS (
  SELECT site, year(start)::INT AS year, month(start)::INT AS month, avg(usable) AS good_fraction, count(*) AS composite_count FROM composites GROUP BY ALL)"""

SNOW = """snow AS (
  SELECT site, year(start)::INT AS year, month(start)::INT AS month, max(((qa & 16384) <> 0)::INT) AS any_flag, count(*) AS record_count FROM composites GROUP BY ALL)"""

_COMPLETE = " AND ".join(f"m.{c} IS NOT NULL" for c in MODEL_FIELDS)
FLAGGED = MASTER + ", " + DAYWEIGHTED + ", " + MONTHLY_QA + ", " + SNOW + f""", flagged AS (
  SELECT *, eligible_primary AS eligible_median_response, eligible_primary AS eligible_raw_exposure,
    (eligible_primary = 1 AND coalesce(good_fraction >= 0.75, false))::INT AS eligible_qa1,
    (eligible_primary = 1 AND coalesce(good_fraction >= 1.0, false))::INT AS eligible_qa2,
    (coalesce(dw_active = 1, false) AND dw_anomaly IS NOT NULL AND eligible_all12 = 1)::INT AS eligible_dayweighted,
    (eligible_primary = 1 AND coalesce(heat > 0, false) AND coalesce(snow_known = 1, false) AND coalesce(snow = 0, false))::INT AS eligible_cold_snow
  FROM (SELECT m.*, q.good_fraction, d.dw_anomaly_mean AS dw_anomaly, d.dayweighted_active AS dw_active, s.any_flag AS snow,
      (s.any_flag IS NOT NULL)::INT AS snow_known, (m.active = 1 AND {_COMPLETE})::INT AS eligible_primary, ({_COMPLETE})::INT AS eligible_all12,
      (m.month BETWEEN 4 AND 9)::INT AS domain_season, (m.month BETWEEN 4 AND 9 AND {_COMPLETE})::INT AS eligible_season
    FROM master m LEFT JOIN monthly_qa q ON q.site = m.site AND q.year = m.year AND q.month = m.month
      LEFT JOIN dayweighted d ON d.site = m.site AND d.year = m.year AND d.month = m.month
      LEFT JOIN snow s ON s.site = m.site AND s.year = m.year AND s.month = m.month))"""


def with_(ctes: str, select: str) -> str:
    """`WITH ctes select`; a select that starts with a comma continues the list of tables."""
    return f"WITH {ctes}{select}" if select.lstrip().startswith(",") else f"WITH {ctes} {select}"
