"""Golden counts that follow from the calendar alone: 247 sites, 300 months, one invalid input."""

import pytest
from pyspark.sql import functions as F

from panelwright.functions import assign_split, index_month, index_year
from panelwright.operators import checks, temporal

FIRST, BAD = 2001 * 12, (233, 2022 * 12 + 9)


@pytest.fixture(scope="module")
def panel(spark):
    df = spark.range(247).select((F.col("id") + 1).cast("int").alias("site"))
    df = df.withColumn("period", F.explode(F.sequence(F.lit(FIRST), F.lit(FIRST + 299))))
    df = df.withColumn("year", index_year("period")).withColumn("month", index_month("period")).withColumn("npp", F.rand(3))
    return df.cache()


@pytest.fixture(scope="module")
def bad(spark):
    return spark.createDataFrame([BAD], "site int, period int")


def test_samples_and_split(panel):
    assert checks.expect_complete_history(panel, ["site"], "period", 300).count() == 0
    index = temporal.assign_sample_id(panel, ["site"], "period", 48).withColumn("split", assign_split("year"))
    counts = {r["split"]: r["count"] for r in index.groupBy("split").count().collect()}
    assert counts == {"train": 41_496, "val": 8_892, "test": 11_856}
    low, high, distinct = index.agg(F.min("sample_id"), F.max("sample_id"), F.count_distinct("sample_id")).first()
    assert (low, high, distinct) == (0, 62_243, 62_244)
    first = index.orderBy("sample_id").first()
    assert (first["site"], first["period"]) == (1, FIRST + 48)


def test_history_windows_keep_the_same_samples(panel):
    kept = temporal.history_samples(panel.withColumn("x", F.col("npp")), ["site"], "period", ["x"], "npp", 48)
    assert kept.count() == 62_244


@pytest.mark.parametrize("window, affected, clean", [(36, 36, 11_820), (48, 38, 11_818)])
def test_exclusion_counts(panel, bad, window, affected, clean):
    test = panel.where(F.col("year") >= 2022)
    marked = temporal.affected_by_invalid(test, bad, ["site"], "period", window)
    assert marked.where("affected").count() == affected
    assert temporal.filter_domain(test, bad, ["site"], "period", window).count() == clean
    earlier = temporal.affected_by_invalid(panel.where(F.col("year") < 2022), bad, ["site"], "period", window)
    assert earlier.where("affected").count() == 0


def test_the_two_extra_keys(panel, bad):
    test = panel.where(F.col("year") >= 2022)
    short, long = (temporal.filter_domain(test, bad, ["site"], "period", w) for w in (36, 48))
    extra = {(r["site"], r["year"], r["month"]) for r in short.join(long, ["site", "period"], "left_anti").collect()}
    assert extra == {(233, 2025, 11), (233, 2025, 12)}
    assert temporal.common_domain(test, bad, ["site"], "period", [6, 12, 18, 24, 36, 48]).count() == 11_818
    years = temporal.complete_years(short.where("year = 2025"), ["site"])
    assert years.count() == 246
