import uuid

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelwright import functions as fn
from panelwright.operators import checks as op
from panelwright.operators import joins
from panelwright.sources import catalogues, composites, readers, schemas, writers


def test_require_columns_raises(spark):
    with pytest.raises(ValueError, match="missing"):
        op.require_columns(spark.range(1), ["id", "x"])


def test_holding_checks_are_empty(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 5.0)], "s int, month int, v double")
    assert op.expect_unique(df, ["s", "month"]).count() == 0
    assert op.expect_finite(df, ["v"]).count() == 0
    assert op.expect_integer_keys(df, ["s"]).count() == 0
    assert op.expect_grid(df, "s", [1, 2], "month", [1, 2]).count() == 0
    assert op.expect_same_keys(df, "s", [1, 2], df.select("month").distinct(), ["month"]).count() == 0
    assert op.expect_join_cardinality(df, df, ["s", "month"]).count() == 0


def test_violations_name_the_key(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 1, float("inf")), (2, 13, None)], "s int, month int, v double")
    assert [r["key"] for r in op.expect_unique(df, ["s", "month"]).collect()] == ["1|1"]
    assert op.expect_finite(df, ["v"]).first()["observed"] == 3
    assert [r["key"] for r in op.expect_integer_keys(df, ["s"]).collect()] == ["month"]
    got = {r["key"]: (r["observed"], r["expected"]) for r in op.expect_grid(df, "s", [1, 3], "month", [1]).collect()}
    assert got == {"1|1": (2.0, 1.0), "3|1": (0.0, 1.0), "2|13": (1.0, 0.0)}


def test_null_keys_are_reported(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "s int, m int")
    assert op.expect_unique(df, ["s"]).first()["key"] == "null"


def test_join_validation_raises(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="one_to_one"):
        joins.attach_one_to_one(a, a.select("k"), ["k"], validate=True)


def test_csv_round_trip_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text("point_id,fold_id\n007,fold_1\n012,fold_5\n")
    rows = readers.scan_csv(spark, str(path), schemas.FOLDS).orderBy("point_id").collect()
    assert [(r["point_id"], r["fold_id"]) for r in rows] == [("007", "fold_1"), ("012", "fold_5")]


def test_csv_with_other_columns_fails(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("point_id,other\n007,1\n")
    with pytest.raises(Exception):
        readers.scan_csv(spark, str(path), schemas.FOLDS).collect()


def test_write_once_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    writers.write_once(spark.range(3), path)
    with pytest.raises(AnalysisException):
        writers.write_once(spark.range(3), path)


def test_tensors_are_read_in_tasks(spark, tmp_path):
    block = np.arange(2 * 3 * 2, dtype=float).reshape(2, 3, 2)
    np.savez(tmp_path / "run.npz", values=block, sample_id=np.array([10, 11]))
    rows = readers.tensor_to_long(readers.read_tensors(spark, str(tmp_path / "*.npz"), "values"), "tensor", ["f", "g"], ["sample_id"]).collect()
    got = {(r["sample_id"], r["lag"], r["feature"]): r["shap"] for r in rows}
    assert len(got) == 12
    assert got[(10, 3, "f")] == 0.0 and got[(10, 1, "g")] == 5.0 and got[(11, 1, "g")] == 11.0


def test_strict_numbers_raise(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert [r["v"] for r in readers.coerce_numeric(df, ["v"]).collect()] == [1.0, None]
    with pytest.raises(Exception):
        readers.coerce_numeric(df, ["v"], strict=True).collect()


def test_sentinel_and_flag(spark):
    df = spark.createDataFrame([(-9999.0,), (float("nan"),), (-0.5,), (None,)], "v double")
    out = readers.sentinel_to_null(readers.keep_invalid_flag(df, "v"), ["v"]).collect()
    assert [(r["v"], r["is_invalid_input"]) for r in out] == [(None, True), (None, True), (-0.5, False), (None, True)]


def test_ids_and_folds(spark):
    df = spark.createDataFrame([("7.0", "fold_3"), ("1234", "fold-3"), ("45", "3"), ("9", "x3")], "i string, f string")
    got = [(r["a"], r["b"]) for r in df.select(fn.normalise_id("i").alias("a"), fn.normalise_fold_label("f").alias("b")).collect()]
    assert got == [("007", 3), ("1234", 3), ("045", 3), ("009", None)]


def test_messages(spark):
    texts = ["", "object 'x' not found", "Rank deficient", "got NaN", "no convergence", "other"]
    want = ["NONE", "STRUCTURAL_ERROR", "NUMERICAL_IDENTIFIABILITY_FAILURE", "NONFINITE_RESULT", "CONVERGENCE_FAILURE", "FIT_ERROR"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fn.classify_message("t")).collect()] == want


def test_catalogues():
    rows = catalogues.run_rows()
    assert len(rows) == 17 and len({r[0] for r in rows}) == 17 and len(catalogues.comparison_pairs()) == 16
    assert len(catalogues.MODELS) == 13 and sum(composites.CLASS_SIZES.values()) == 247


def test_stratified_sample_counts(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("int").alias("c"))
    out = composites.stratified_fixed_sample(df, "c", {0: 5, 1: 7}, ["id"], 1)
    assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {0: 5, 1: 7}
    assert sorted(r["point_id"] for r in out.collect()) == list(range(12))
    again = composites.stratified_fixed_sample(df.repartition(7), "c", {0: 5, 1: 7}, ["id"], 1)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in out.collect())
