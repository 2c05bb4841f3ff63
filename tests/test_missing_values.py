import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright import functions as fn
from panelwright.operators import agreement, metrics

ROWS = [("a", 1, 1, 1.0, 1.5), ("a", 1, 2, 2.0, None), ("a", 1, 3, 4.0, 3.5), ("a", 1, 4, 9.0, float("nan")), ("b", 1, 5, None, 1.0), ("a", 2, 1, 1.0, 2.0), ("a", 2, 2, 3.0, 3.0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "m string, seed int, site int, y_true double, y_pred double")


def test_metrics_run_over_complete_pairs(frame):
    got = {(r["m"], r["seed"]): r for r in metrics.regression_metrics(frame, ["m", "seed"]).collect()}
    y, p = np.array([1.0, 4.0]), np.array([1.5, 3.5])
    r = got["a", 1]
    assert r["n"] == 2 and r["rmse"] == pytest.approx(np.sqrt(((p - y) ** 2).mean())) and r["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["b", 1]["n"] == 0 and got["b", 1]["rmse"] is None


def test_sums_and_summaries_agree_with_them(frame):
    one = {r["m"]: r for r in metrics.metrics_from_sums(metrics.cluster_sufficient_stats(frame.where("seed = 1"), ["m"]), ["m"]).collect()}
    direct = {r["m"]: r for r in metrics.regression_metrics(frame.where("seed = 1"), ["m"]).collect()}
    for k in ("n", "rmse", "mae", "r2", "bias", "pearson_r"):
        assert one["a"][k] == pytest.approx(direct["a"][k])
    assert one["b"]["n"] == 0 and one["b"]["rmse"] is None
    (whole,) = metrics.metrics_mean_sd(frame, [], entity="site").collect()
    assert whole["entities"] == 2 and whole["n_seeds"] == 2 and whole["records_per_seed"] == 2
    levels = {(r["grouping"], r["level"]): r for r in metrics.grouped_metrics(frame, ["m"]).collect()}
    assert levels["all", "all"]["records_per_seed"] == 2 and levels["m", "b"]["n_seeds"] == 0


def test_a_deterministic_model_is_one_run(frame):
    both = frame.unionByName(frame.where("m = 'a' and seed = 1").withColumn("seed", F.lit(7)))
    got = {(r["m"], r["domain"]): r for r in metrics.dual_domain_table(both, F.col("site") == 3, "m", deterministic=["a"]).collect()}
    assert got["a", "full"]["n_seeds"] == 1 and got["a", "full"]["rmse_sd"] is None and got["a", "full"]["records_per_seed"] == 2 and got["a", "clean"]["records_per_seed"] == 1


def test_highest_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([("g", "b", 2, 5.0), ("g", "a", 3, 5.0), ("g", "a", 1, float("inf")), ("g", "c", 0, None)], "g string, name string, k int, v double")
    assert metrics.highest_by(df, ["g"], "v", ["name"]).first()["name"] == "a" and metrics.highest_by(df, ["g"], "v", ["k"]).first()["k"] == 2


def test_ungrouped_distribution_comparison(spark):
    a, b = (spark.createDataFrame([(float(v),) for v in values], "v double") for values in (range(20), range(5, 30)))
    (w,) = agreement.wasserstein_1d(a, b, "v", []).collect()
    assert w["wasserstein"] == pytest.approx(abs(np.mean(range(20)) - np.mean(range(5, 30))))
    (s,) = agreement.shift_summary(a, b, "v", []).collect()
    assert s["training_n"] == 20 and s["evaluation_n"] == 25 and s["median_shift"] == pytest.approx((17 - 9.5) / 9.5)


def test_decisions_without_evidence(spark):
    df = spark.createDataFrame([("QA1", -1.0, -0.5, None, False), ("QA1", float("nan"), -0.5, True, None), ("QA2", float("nan"), None, True, False), ("QA2", 1.0, 2.0, None, None), ("QA1", -1.0, -0.5, True, None)], "a string, e double, hi double, s boolean, st boolean")
    got = [r[0] for r in df.select(fn.decision_label("a", "e", "hi", "s", "st")).collect()]
    assert got == ["QA1_SUPPORT_FAIL", "QA1_DIRECTION_FAIL", "QA2_DIAGNOSTIC_STOP", "QA2_COVERAGE_LIMITED_FIXED_CONTRAST_UNSUPPORTED", "QA1_ROBUSTNESS_PASS"]


def test_labels_of_domains_and_added_covariates(spark):
    rows = [("FULL_YEAR", -1.0, -0.5, True, False), ("FULL_YEAR", -1.0, None, True, None), ("APR_SEP", 0.0, -0.5, True, False), ("APR_SEP", 2.0, 3.0, True, False), ("APR_SEP", None, -1.0, True, False), ("APR_SEP", None, None, None, True)]
    df = spark.createDataFrame(rows, "a string, e double, hi double, s boolean, st boolean")
    assert [r[0] for r in df.select(fn.domain_label("a", "e", "hi", "s", "st")).collect()] == [
        "FULL_YEAR_DIRECTION_AND_INTERVAL_CONSISTENT", "FULL_YEAR_DIRECTIONALLY_CONSISTENT_BUT_IMPRECISE", "APR_SEP_ROBUSTNESS_PASS",
        "APR_SEP_SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED", "DOMAIN_SENSITIVITY_DIAGNOSTIC_STOP", "DOMAIN_SENSITIVITY_FIXED_CONTRAST_UNSUPPORTED",
    ]
    rows = [("Model2", -1.0, -0.5, True, False), ("model3", -1.0, -0.5, True, None), ("MODEL3", -1.0, None, True, False), ("MODEL2", 0.0, -1.0, True, False), ("MODEL2", 1.0, 2.0, True, False), ("MODEL2", 1.0, 2.0, None, False), ("MODEL2", None, 2.0, False, False)]
    df = spark.createDataFrame(rows, "a string, e double, hi double, s boolean, st boolean")
    assert [r[0] for r in df.select(fn.adjustment_label("a", "e", "hi", "s", "st")).collect()] == [
        "MODEL2_ADJUSTMENT_ROBUSTNESS_PASS", "MODEL3_HIGH_ADJUSTMENT_DIRECTION_AND_INTERVAL_CONSISTENT", "MODEL3_DIRECTIONALLY_CONSISTENT_BUT_IMPRECISE",
        "MODEL2_ZERO_CONTRAST_ANALYSIS_CHECK_REQUIRED", "MODEL2_SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED", "MODEL2_FIXED_CONTRAST_UNSUPPORTED", "MODEL2_DIAGNOSTIC_STOP",
    ]
