from pyspark.sql import functions as F

from panelwright.operators import metrics


def test_a_constant_prediction_has_no_correlation_however_it_is_split(spark):
    """Merging moments of several tasks may leave a variance just above zero."""
    group = F.col("id") % 500
    df = spark.range(40_000).select(group.alias("g"), (0.1 + group / 997).alias("y_pred"), F.rand(1).alias("y_true")).repartition(3)
    got = metrics.regression_metrics(df, ["g"]).collect()
    assert len(got) == 500 and all(r["pearson_r"] is None and r["r2"] is not None for r in got)
    back = metrics.regression_metrics(df.select("g", F.col("y_pred").alias("y_true"), F.col("y_true").alias("y_pred")), ["g"]).collect()
    assert all(r["r2"] is None and r["pearson_r"] is None for r in back)
