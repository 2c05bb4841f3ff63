import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import agreement, attribution, baselines, metrics, resampling


@pytest.fixture(scope="module")
def predictions(spark):
    """Hot site 0 holds a third of the rows; values sit on a large offset."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        site = 0 if i % 3 == 0 else 1 + i % 9
        y = 1e4 + rng.normal()
        for seed in (1, 2):
            rows.append((seed, site, i, float(y), float(y + rng.normal() * 0.3 + 0.1 * seed)))
    return rows, spark.createDataFrame(rows, "seed int, site int, t int, y_true double, y_pred double")


def direct(y, p):
    e = p - y
    sst = ((y - y.mean()) ** 2).sum()
    return dict(rmse=np.sqrt((e**2).mean()), mae=abs(e).mean(), r2=1 - (e**2).sum() / sst, bias=e.mean(), pearson_r=np.corrcoef(y, p)[0, 1])


def test_metrics_match_two_pass(predictions):
    rows, df = predictions
    a = np.array(rows)
    got = {r["seed"]: r for r in metrics.regression_metrics(df, ["seed"]).collect()}
    centred = metrics.metrics_from_sums(metrics.cluster_sufficient_stats(df, ["seed"], center=1e4), ["seed"])
    sums = {r["seed"]: r for r in centred.collect()}
    for s in (1, 2):
        k = a[:, 0] == s
        for m, v in direct(a[k, 3], a[k, 4]).items():
            assert got[s][m] == pytest.approx(v, rel=1e-9, abs=1e-9)
            assert sums[s][m] == pytest.approx(v, rel=1e-7, abs=1e-9)


def test_no_variance_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y_true double, y_pred double")
    r = metrics.regression_metrics(df).first()
    assert r["r2"] is None and r["pearson_r"] is None and r["rmse"] == pytest.approx(np.sqrt(2.5))
    s = metrics.metrics_from_sums(metrics.cluster_sufficient_stats(df, []), []).first()
    assert s["r2"] is None and s["pearson_r"] is None


def test_bootstrap_equals_resampling_raw_rows(predictions):
    rows, df = predictions
    a = np.array(rows)
    stats = metrics.cluster_sufficient_stats(df, ["site", "seed"], center=1e4)
    got = {(r["rep"], r["seed"]): r for r in resampling.cluster_bootstrap(stats, ["site"], 5, 99, ["seed"]).collect()}
    sites = sorted({r[1] for r in rows})
    for rep in range(1, 6):
        drawn = [sites[int(hashlib.md5(f"99:{rep}:{pos}".encode()).hexdigest()[:15], 16) % len(sites)] for pos in range(len(sites))]
        for seed in (1, 2):
            parts = [a[(a[:, 0] == seed) & (a[:, 1] == s)] for s in drawn]
            x = np.concatenate(parts)
            for m, v in direct(x[:, 3], x[:, 4]).items():
                assert got[(rep, seed)][m] == pytest.approx(v, rel=1e-6, abs=1e-8)


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(40).select(F.col("id").alias("site"))
    a, b = (sorted(map(tuple, resampling.multiplicities(df.repartition(k), ["site"], 30, 7).collect())) for k in (1, 9))
    assert a == b
    assert sum(r[2] for r in a) == 40 * 30


def test_stratified_draws_stay_in_their_stratum(spark):
    df = spark.range(30).select(F.col("id").alias("site"), F.when(F.col("id") < 20, "big").otherwise("small").alias("c"))
    out = resampling.multiplicities(df, ["site"], 25, 3, ["c"])
    assert {r["c"]: r["n"] for r in out.groupBy("c").agg(F.sum("multiplicity").alias("n")).collect()} == {"big": 500, "small": 250}
    assert out.where("(c = 'big') <> (site < 20)").count() == 0


def test_copies_restart_sections(spark):
    df = spark.createDataFrame([(s, t) for s in (1, 2) for t in (0, 1, 3)], "site int, t int")
    draws = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "attempt int, site int, copy int")
    out = resampling.resample_panel(df, draws, "site", "t")
    assert out.where("section_start").count() == 4 and out.count() == 6


def test_simultaneous_interval(spark):
    rng = np.random.default_rng(0)
    draws = rng.normal(size=(200, 2)) * [1.0, 3.0]
    rows = [(i, n, float(draws[i, j])) for i in range(200) for j, n in enumerate("ab")]
    est = spark.createDataFrame([("a", 0.1), ("b", -0.2)], "name string, estimate double")
    got = {r["name"]: r for r in resampling.simultaneous_interval(est, spark.createDataFrame(rows, "rep int, name string, v double"), "name", "v").collect()}
    z = abs(draws - [0.1, -0.2]) / draws.std(axis=0, ddof=1)
    critical = np.quantile(z.max(axis=1), 0.95)
    assert got["a"]["critical"] == pytest.approx(critical)
    assert got["b"]["simultaneous_upper"] == pytest.approx(-0.2 + critical * draws[:, 1].std(ddof=1))


def tau_b(x, y):
    c = d = tx = ty = 0
    for i, j in combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        c, d = c + (a * b > 0), d + (a * b < 0)
        tx, ty = tx + (a != 0), ty + (b != 0)
    return (c - d) / np.sqrt(tx * ty)


@pytest.mark.parametrize("bounded", [True, False])
def test_kendall_matches_all_pairs(spark, bounded):
    rng = np.random.default_rng(8)
    data = {g: (rng.integers(0, k, n), rng.integers(0, k, n)) for g, n, k in (("a", 60, 8), ("b", 33, 100), ("c", 5, 2))}
    rows = [(g, i, float(x[i]), float(y[i])) for g, (x, y) in data.items() for i in range(len(x))]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    got = {r["g"]: r["kendall"] for r in agreement.kendall_tau_b(df, "x", "y", ["g"], ["i"], bounded).collect()}
    for g, (x, y) in data.items():
        assert got[g] == pytest.approx(tau_b(x, y), abs=1e-12)
    alone = agreement.kendall_tau_b(df.where("g = 'a'"), "x", "y", [], ["i"], bounded).first()["kendall"]
    assert alone == pytest.approx(tau_b(*data["a"]), abs=1e-12)


def test_wasserstein_matches_the_merged_grid(spark):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(size=90), 1), np.round(rng.normal(size=50) + 0.4, 1)
    grid = np.sort(np.concatenate([a, b]))
    cdf = [np.searchsorted(np.sort(v), grid[:-1], side="right") / len(v) for v in (a, b)]
    want = (abs(cdf[0] - cdf[1]) * np.diff(grid)).sum()
    left, right = (spark.createDataFrame([("g", float(v)) for v in x], "g string, v double") for x in (a, b))
    assert agreement.wasserstein_1d(left, right, "v", ["g"]).first()["wasserstein"] == pytest.approx(want, abs=1e-12)


def test_kappa(spark):
    rows = [("x", "x")] * 4 + [("x", "y")] * 2 + [("y", "y")] * 3 + [("z", "y")]
    r = agreement.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    expected = 0.6 * 0.4 + 0.3 * 0.6
    assert r["agreement"] == pytest.approx(0.7) and r["kappa"] == pytest.approx((0.7 - expected) / (1 - expected))


def test_midrank_counts_the_target(spark):
    hist = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 5.0)], "k int, v double")
    df = spark.createDataFrame([(1, 2.0), (1, 0.0), (1, None), (2, 1.0)], "k int, v double")
    got = {(r["k"], r["v"]): r["v_rank"] for r in baselines.midrank_vs_history(df, hist, ["k"], ["v"]).collect()}
    assert got == {(1, 2.0): (1 + 1.5) / 5, (1, 0.0): 0.5 / 5, (1, None): None, (2, 1.0): None}


def test_empirical_rank(spark):
    pool = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "p double")
    df = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (2.0,)], "v double")
    got = sorted((r["v"], r["r"]) for r in baselines.empirical_rank(df, "v", pool, "p", "r").collect())
    assert got == [(0.0, 0.5 / 5), (2.0, 2.5 / 5), (2.0, 2.5 / 5), (3.0, 3.5 / 5)]


def test_points_without_support_stay(spark):
    df = spark.createDataFrame([(1, 2000, 0.1, 0.1)], "site int, year int, x double, y double")
    got = {r["point"]: r["n_records"] for r in baselines.support_counts(df, "x", "y", [("A", 0.1, 0.15), ("B", 0.9, 0.9)], "site").collect()}
    assert got == {"A": 1, "B": 0}


def test_dominance_ties_and_top2(spark):
    rows = [("r", 1, "c", "f", 2.0), ("r", 1, "c", "g", 2.0), ("r", 1, "c", "h", 1.0)]
    df = spark.createDataFrame(rows, "run string, site int, class string, feature string, mean_abs double")
    groups = {"F": ["f"], "G": ["g"], "H": ["h"]}
    shares = attribution.site_group_shares(df, ["run", "class"], "site", groups, list(groups))
    assert {r["group"]: (r["dominant"], r["n_tied"]) for r in shares.collect()} == {"F": (1, 2), "G": (1, 2), "H": (0, 2)}
    top = {r["group"]: r for r in attribution.class_top2(shares, ["run"], "class").collect()}
    assert top["F"]["top1_group"] == "F;G" and top["F"]["top2_group"] == "H" and top["H"]["rank"] == 3
    assert top["F"]["margin"] == pytest.approx(0.2)
    first = {r["group"]: r["class_dominant"] for r in attribution.class_summary(shares, ["run"], "class", list(groups)).collect()}
    assert first == {"F": True, "G": False, "H": False}


def test_ledger_stops_at_the_target(spark):
    rows = [(i, i % 10 != 0, "FIT_ERROR") for i in range(1, 101)]
    r = metrics.attempt_ledger(spark.createDataFrame(rows, "a int, ok boolean, c string"), "a", "ok", "c", 45).first()
    assert (r["attempts"], r["successes"], r["failures"], r["verdict"]) == (49, 45, 4, "STOP")


def test_depth_none_ranks_last(spark):
    rows = [("f", 10, "None", 1, 0.5), ("f", 10, "20", 1, 0.5), ("f", 10, "20", 3, 0.5), ("f", 20, "20", 3, 0.4999), ("f", 5, "None", 1, 0.7)]
    df = spark.createDataFrame(rows, "m string, trees int, depth string, leaf int, s double")
    depth = F.coalesce(F.col("depth").try_cast("double"), F.lit(float("inf")))
    best = metrics.grid_winner(df.where("s >= 0.5"), ["m"], "s", [F.col("trees"), depth, F.col("leaf").desc()]).first()
    assert (best["trees"], best["depth"], best["leaf"], best["tie"]) == (10, "20", 3, True)


def test_window_rule_on_published_scores(spark):
    scores = {6: (0.07331, 0.06588, 0.06554), 12: (0.05803, 0.05683, 0.05803), 18: (0.05554, 0.05553, 0.05436),
              24: (0.05549, 0.05614, 0.05402), 36: (0.05103, 0.05800, 0.05310), 48: (0.05790, 0.05215, 0.05422)}
    df = spark.createDataFrame([(w, s) for w, v in scores.items() for s in v], "w int, s double")
    best = metrics.select_best(df, "w", "s").where("selected").first()
    assert best["w"] == 36 and best["mean"] == pytest.approx(0.05404, abs=1e-5)
