"""Scans, column contracts, sinks and record-to-month tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from panelwright.functions import normalise_fold_label, normalise_id
from panelwright.operators.checks import require_columns
from panelwright.operators.metrics import metrics_mean_sd
from panelwright.plans import tables as T
from panelwright.plans.registry import query
from panelwright.plans.tables import DRAWS, FEATURES, SEED, TRAIN_END, WINDOW, Tables, with_
from panelwright.session import ensure_checkpoint_dir
from panelwright.sources import arrays, catalogues, composites, readers, writers


def _export_path(t: Tables) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/exports/{uuid.uuid4().hex}"


@query("a01_scan_csv", "SELECT s_suppkey::VARCHAR AS point_id, s_name, s_nationkey, s_acctbal FROM supplier", "s_acctbal")
def scan_csv(t: Tables):
    schema = ST.StructType.fromDDL("point_id string, s_name string, s_nationkey int, s_acctbal double")
    path = _export_path(t)
    writers.write_csv(t.raw("supplier").select(F.col("s_suppkey").alias("point_id"), "s_name", "s_nationkey", "s_acctbal"), path)
    return readers.scan_csv(t.spark, path, schema)


@query("a02_require_columns", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def required(t: Tables):
    return require_columns(t.raw("lineitem"), ["l_orderkey", "l_returnflag"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("a03_alias_columns", "SELECT c_custkey AS point_id, c_nationkey AS fold_id, c_acctbal AS y_true FROM customer", "y_true")
def aliases(t: Tables):
    names = {"c_custkey": "point_id", "c_nationkey": "fold_id", "c_acctbal": "y_true", "absent": "y_pred"}
    return readers.alias_columns(t.raw("customer"), names).select("point_id", "fold_id", "y_true")


@query("a04_normalise_id", "SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS point_id FROM customer")
def ids(t: Tables):
    return t.raw("customer", "c_custkey").select("c_custkey", normalise_id(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("point_id"))


@query("a05_coerce_numeric", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS word FROM events", "k word")
def coerce(t: Tables):
    rows = t.raw("events", "event_id", "event_type", "props").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("word"))
    return readers.coerce_numeric(rows, ["k", "word"])


@query("a05_coerce_numeric_strict", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events", "k")
def coerce_strict(t: Tables):
    rows = t.raw("events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return readers.coerce_numeric(rows, ["k"], strict=True)


@query("a06_sentinel_to_null", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.05) AS l_discount, nullif(l_tax, 0.05) AS l_tax FROM lineitem", "l_discount l_tax")
def sentinel(t: Tables):
    return readers.sentinel_to_null(t.raw("lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], 0.05)


@query("a07_keep_invalid_flag", with_(T.DENSE, "SELECT site, period, nullif(load, 1) AS load, (load IS NULL OR load = 1) AS is_invalid_input FROM dense"), "load")
def invalid_flag(t: Tables):
    rows = t.dense.select(
        "site", "period", "load", readers.invalid_input("load", 1).alias("is_invalid_input")
    )
    return readers.sentinel_to_null(rows, ["load"], 1)


@query("a08_normalise_fold_label", "SELECT c_custkey, label, CASE WHEN kind = 3 THEN NULL ELSE fold END AS fold FROM (SELECT c_custkey, fold, kind, (CASE kind WHEN 0 THEN 'fold_' WHEN 1 THEN 'Fold-' WHEN 2 THEN '' ELSE 'part ' END) || fold AS label FROM (SELECT c_custkey, (c_nationkey % 5)::INT AS fold, c_custkey % 4 AS kind FROM customer))")
def fold_label(t: Tables):
    fold = F.pmod("c_nationkey", F.lit(5)).cast("int")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("fold_", "Fold-", "", "part ")]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    label = F.concat(prefix, fold.cast("string"))
    return t.raw("customer").select("c_custkey", label.alias("label"), normalise_fold_label(label).alias("fold"))


def _draw_frames(t: Tables):
    ordered = readers.dense_order(t.manifest, "draw", ["site", "year", "month"])
    return ordered, [ordered.where(F.col("draw") == d) for d in DRAWS]


@query("a09_union_manifests", with_(T.MANIFEST, "SELECT draw, site, class, year, month, row_number() OVER (PARTITION BY draw ORDER BY site, year, month) - 1 AS row_order FROM manifest"))
def union_manifests(t: Tables):
    return readers.union_manifests(_draw_frames(t)[1]).select("draw", "site", "class", "year", "month", "row_order")


@query("a09_manifest_differences", with_(T.MANIFEST, "SELECT draw, site, year, month, -1::BIGINT AS surplus FROM manifest WHERE draw = 'E3'"))
def manifest_differences(t: Tables):
    frames = [t.manifest.where(F.col("draw") == d).select("draw", "site", "year", "month") for d in DRAWS[:3]]
    return readers.manifest_differences(readers.union_manifests(frames), t.manifest)


@query("a09_manifest_order_violations", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS distinct_orders, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 0 OR max(l_linenumber) <> count(*) - 1")
def manifest_order(t: Tables):
    return readers.manifest_order_violations(t.raw("lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("a10_tensor_to_long", with_(T.FEATURES_LONG, "SELECT site, period, lag, feature, value FROM features_long"), "value")
def tensor_to_long(t: Tables):
    tensor = F.transform(f"history_{WINDOW}", lambda s: F.array(*[s[f] for f in FEATURES]))
    rows = t.samples.select("site", "period", tensor.alias("tensor"))
    return readers.tensor_to_long(rows, "tensor", FEATURES, ["site", "period"], "value")


@query("a10_array_rows", with_(T.FEATURES_LONG, "SELECT site, period, lag, feature, value FROM features_long"), "value")
def array_rows(t: Tables):
    """The histories written as array files by the tasks that hold them, and read back by ranges of rows."""
    path = _export_path(t)
    history = F.flatten(F.transform(f"history_{WINDOW}", lambda s: F.array(*[s[f] for f in FEATURES])))
    arrays.write_array(t.samples.select(F.concat(F.array(F.col("site").cast("double"), F.col("period").cast("double")), history).alias("cells")), path, "cells")
    rows = arrays.read_array(t.spark, path, split=1 << 20)
    steps = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda i: F.slice("cells", i * len(FEATURES) + 3, F.lit(len(FEATURES))))
    keys = [F.col("cells")[i].cast(t.samples.schema[k].dataType).alias(k) for i, k in enumerate(("site", "period"))]
    return readers.tensor_to_long(rows.select(*keys, steps.alias("tensor")), "tensor", FEATURES, ["site", "period"], "value")


@query("a11_write_once", with_(T.PANEL, "SELECT site, period, target FROM panel"), "target")
def write_once(t: Tables):
    path = _export_path(t)
    writers.write_once(t.panel.select("site", "period", "target"), path)
    return readers.scan_parquet(t.spark, path)


@query("a12_write_partitioned", with_(T.PREDICTIONS, "SELECT fold, seed, count(*) AS n, sum(y_pred) AS total FROM predictions GROUP BY ALL"), "total", digits=6)
def write_partitioned(t: Tables):
    path = _export_path(t)
    writers.write_partitioned(t.predictions.select("fold", "seed", "y_pred"), path, ["fold"])
    return readers.scan_parquet(t.spark, path).groupBy("fold", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred").alias("total"))


@query("a13_composites_to_monthly", """SELECT l_suppkey, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) * 0.0001 AS NPP,
    avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) * 0.02 - 273.15 AS LST_Day_1km FROM lineitem GROUP BY ALL""", "NPP LST_Day_1km")
def composites_to_monthly(t: Tables):
    band = F.when(F.col("l_linestatus") == "O", "NPP").otherwise("LST_Day_1km")
    rows = t.raw("lineitem", "l_suppkey", "l_shipdate", "l_linestatus", "l_quantity").withColumn("band", band)
    spec = {k: composites.BANDS[k] for k in ("NPP", "LST_Day_1km")}
    return composites.composites_to_monthly(rows, ["l_suppkey"], "l_shipdate", "band", "l_quantity", spec)


@query("a14_monthly_flag_any", with_(T.COMPOSITES + ", " + T.SNOW, "SELECT * FROM snow"))
def flag_any(t: Tables):
    return t.snow


@query("a14_monthly_flag_any_events", "SELECT user_id, year(ts)::INT AS year, month(ts)::INT AS month, max(((event_id & 4096) <> 0)::INT) AS any_flag, count(*) AS record_count FROM events GROUP BY ALL")
def flag_any_events(t: Tables):
    return composites.monthly_flag_any(t.raw("events", "user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 4096)


@query("a15_stratified_fixed_sample", f"""WITH h AS (SELECT c_custkey, c_mktsegment, md5('{SEED}:' || c_custkey) AS h FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS rn FROM h)
  SELECT c_custkey, c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment, h, c_custkey) - 1)::INT AS point_id FROM k
  WHERE rn <= CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 15 WHEN 'MACHINERY' THEN 29 WHEN 'FURNITURE' THEN 32 ELSE 0 END""")
def stratified_sample(t: Tables):
    sizes = {"HOUSEHOLD": 15, "MACHINERY": 29, "FURNITURE": 32}
    return composites.stratified_fixed_sample(t.raw("customer", "c_custkey", "c_mktsegment"), "c_mktsegment", sizes, ["c_custkey"], SEED)


@query("a16_formatted_report", with_(T.PREDICTIONS, f"""SELECT CASE model WHEN 'site_month' THEN 1 ELSE 2 END AS position, model,
    printf('%.3f [%.3f, %.3f]', bias_mean, bias_mean - bias_sd, bias_mean + bias_sd) AS bias, printf('%.3f ± %.3f', rmse_mean, rmse_sd) AS rmse, printf('%.3f ± %.3f', mae_mean, mae_sd) AS mae
  FROM (SELECT model, {T.MEAN_SD_SQL} FROM (SELECT model, seed, {T.METRICS_SQL} FROM predictions GROUP BY ALL) GROUP BY model)"""))
def formatted_report(t: Tables):
    table = metrics_mean_sd(t.predictions, ["model"])
    span = table.withColumns({"_low": F.col("bias_mean") - F.col("bias_sd"), "_high": F.col("bias_mean") + F.col("bias_sd")})
    bias = span.select("model", writers.interval_text("bias_mean", "_low", "_high").alias("bias"))
    return writers.formatted_report(table, "model", ["rmse", "mae"], ["site_month", "month"]).join(bias, "model")


_RUN_CATALOGUE = f"""SELECT i, CASE WHEN i < 12 THEN 'background_BG' || n || '_D' || (i % 3 + 1) WHEN i < 14 THEN 'seed_' || s ELSE 'explained_E' || (i - 13) END AS run_id, s AS model_seed,
    'BG' || n || '_D' || CASE WHEN i < 12 THEN i % 3 + 1 ELSE 1 END AS background_draw, n AS background_n, 'EXPLAINED_E' || CASE WHEN i < 14 THEN 0 ELSE i - 13 END AS explained_draw
  FROM (SELECT i, CASE i WHEN 12 THEN 2024 WHEN 13 THEN 3407 ELSE 42 END::INT AS s, CASE WHEN i < 12 THEN [64, 128, 256, 512][i // 3 + 1] ELSE 256 END::INT AS n FROM (SELECT unnest(range(17))::INT AS i))"""


@query("a17_run_catalogue", with_(T.PANEL, f"""SELECT run_id, model_seed, background_draw, background_n, explained_draw, count(target) AS n_rows, sum(target) AS total
  FROM ({_RUN_CATALOGUE}) c LEFT JOIN panel ON c.i = panel.period % 17 GROUP BY ALL"""), "total", digits=6)
def run_catalogue(t: Tables):
    ids = F.array(*[F.lit(r[0]) for r in catalogues.run_rows()])
    runs = t.panel.select(F.element_at(ids, (F.pmod("period", F.lit(17)) + 1).cast("int")).alias("run_id"), "target")
    totals = runs.groupBy("run_id").agg(F.count("target").alias("n_rows"), F.sum("target").alias("total"))
    return catalogues.run_catalogue(t.spark).join(totals, "run_id", "left").fillna(0, ["n_rows"])


@query("a17_comparison_pairs", with_(T.PANEL, f""", cat AS ({_RUN_CATALOGUE}), per AS (SELECT run_id, avg(target) AS mean FROM cat JOIN panel ON cat.i = panel.period % 17 GROUP BY ALL)
  SELECT CASE WHEN i < 12 THEN 'background' WHEN i < 14 THEN 'model_seed' ELSE 'explained_sample' END AS family, r.run_id AS reference, o.run_id AS other, o.mean - r.mean AS difference
  FROM per r JOIN (SELECT i, cat.run_id, mean FROM cat JOIN per USING (run_id)) o ON r.run_id = 'background_BG256_D1' AND o.run_id <> r.run_id"""), "difference")
def comparison_pairs(t: Tables):
    ids = F.array(*[F.lit(r[0]) for r in catalogues.run_rows()])
    runs = t.panel.groupBy(F.element_at(ids, (F.pmod("period", F.lit(17)) + 1).cast("int")).alias("run_id")).agg(F.avg("target").alias("mean"))
    pairs = t.spark.createDataFrame(catalogues.comparison_pairs(), "family string, reference string, other string")
    ends = [runs.select(F.col("run_id").alias(c), F.col("mean").alias(f"_{c}")) for c in ("reference", "other")]
    return pairs.join(ends[0], "reference").join(ends[1], "other").select("family", "reference", "other", (F.col("_other") - F.col("_reference")).alias("difference"))


@query("a17_model_catalogue", with_(T.PREDICTIONS, """SELECT model, stochastic, count(*) AS n, count(DISTINCT seed) AS seeds FROM (SELECT CASE model WHEN 'month' THEN 'Monthly climatology' ELSE 'point-month climatology' END AS model, false AS stochastic, seed FROM predictions) GROUP BY ALL"""))
def model_catalogue(t: Tables):
    names = F.when(F.col("model") == "month", "Monthly climatology").otherwise("point-month climatology")
    rows = t.predictions.select(names.alias("model"), "seed")
    joined = rows.join(F.broadcast(catalogues.model_catalogue(t.spark)), "model")  # 13 literal rows
    return joined.groupBy("model", "stochastic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("seeds"))
