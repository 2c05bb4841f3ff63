import pytest
from pyspark.sql import functions as F

from panelwright.operators import checks
from panelwright.operators import rule_suite as S

ROWS = [(1, 1, "a", 0.5, True), (2, 13, "b", float("nan"), False), (None, None, None, None, None), (2, 3, "z", 9.0, True), (3, 4, "z", -1.0, False)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "k long, month int, c string, v double, f boolean")


def plain(rows):
    return sorted(map(tuple, rows.collect()), key=repr)


def test_same_violations_as_the_single_operators(df):
    rules = [*S.finite_rules(["v", "k"]), *S.integer_rules(["k"], "month"), S.domain_rule("c", ["a", "b"])]
    single = checks.expect_finite(df, ["v", "k"]).unionByName(checks.expect_integer_keys(df, ["k"])).unionByName(checks.expect_domain(df, "c", ["a", "b"]))
    assert plain(S.run_rules(df, rules)) == plain(single)


def test_other_rules_and_report(df):
    rules = [S.range_rule("v", 0, 5, ["c"]), S.definition_rule("k", F.col("month") - 1), S.flag_rule("f", F.col("v") > 0, F.col("f"), ["k"]), S.range_rule("k", 0, 9)]
    assert plain(S.run_rules(df, rules)) == [("definition", "k", 2.0, 0.0), ("flag", "2", 1.0, 0.0), ("range", "z", 2.0, 0.0)]
    got = {(r["check"], r["key"]): (r["rows"], r["broken"], r["status"]) for r in S.rule_report(df, rules).collect()}
    assert got["range", "v"] == (5, 2, "FAIL") and got["range", "k"] == (5, 0, "PASS")


def test_nothing_failed_and_empty(df):
    assert S.run_rules(df, [S.range_rule("k", 0, 9), S.domain_rule("month", [1, 13, 3, 4, None])]).where("check = 'range'").count() == 0
    assert S.run_rules(df.where("false"), [*S.finite_rules(["v"]), S.domain_rule("c", ["a"])]).count() == 0
    with pytest.raises(ValueError):
        S.run_rules(df, [*S.finite_rules(["v"]), *S.finite_rules(["v"])])
