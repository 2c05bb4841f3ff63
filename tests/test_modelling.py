import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import modelling as op

SPEC = op.AdditiveSpec(
    response="r", x="p", y="q", knots=(0.0, 0.5, 1.0), controls={"c": (-1.0, 0.0, 1.0)}, months=(1, 2, 3, 4), years=(2000, 2001, 2002),
    site="site", time="period", ridge=0.01, site_ridge=2.0,
)


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(11)
    rows = []
    for s in range(8):
        effect = rng.normal()
        for y in SPEC.years:
            for m in SPEC.months:
                if rng.random() < 0.1:
                    continue
                p, q, c = rng.random(), rng.random(), rng.normal()
                r = 2 * p - q + 0.5 * c + 0.1 * m + effect + rng.normal() * 0.2
                rows.append((s, y, m, y * 4 + m, float(p), float(q), float(c), float(r)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, panel):
    df = spark.createDataFrame(panel, "site int, year int, month int, period int, p double, q double, c double, r double")
    return df.repartition(5).cache()


def hats(v, knots):
    return np.array([np.interp(v, knots, row) for row in np.eye(len(knots))])


def design(row):
    s, y, m, t, p, q, c, r = row
    return np.concatenate([
        np.outer(hats(p, SPEC.knots), hats(q, SPEC.knots)).ravel(), hats(c, SPEC.controls["c"])[1:],
        [float(m == k) for k in SPEC.months[1:]], [float(y == k) for k in SPEC.years[1:]],
    ])


def full_solve(series, rho):
    """The penalised least squares with explicit site columns, whitened inside sections."""
    xs, ys, zs = [], [], []
    s = np.sqrt(1 - rho**2)
    for k, rows in enumerate(series):
        previous = None
        for row in sorted(rows, key=lambda r: r[3]):
            x, y = design(row), row[7]
            z = np.zeros(len(series))
            z[k] = 1.0
            if previous is not None and row[3] - previous[3] == 1:
                px = design(previous)
                xs.append((x - rho * px) / s)
                ys.append((y - rho * previous[7]) / s)
                zs.append(z * (1 - rho) / s)
            else:
                xs.append(x)
                ys.append(y)
                zs.append(z)
            previous = row
    a = np.column_stack([np.array(xs), np.array(zs)])
    width = len(xs[0])
    penalty = np.diag([SPEC.ridge] * width + [SPEC.site_ridge] * len(series))
    beta = np.linalg.solve(a.T @ a + penalty, a.T @ np.array(ys))
    return beta[:width], beta[width:]


def by_site(rows):
    return [[r for r in rows if r[0] == s] for s in sorted({r[0] for r in rows})]


@pytest.mark.parametrize("rho", [0.0, 0.4])
def test_surface_fit_equals_the_full_solve(frame, panel, rho):
    fit = op.additive_surface_fit(frame, SPEC, rho)
    beta, effects = full_solve(by_site(panel), rho)
    assert len(beta) == SPEC.width
    np.testing.assert_allclose(fit.coefficients["all"], beta, atol=1e-8)
    got = {(r["site"], r["period"]): r for r in op.residuals(frame, fit).collect()}
    for row in panel:
        r = got[(row[0], row[3])]
        assert r["site_effect"] == pytest.approx(effects[row[0]], abs=1e-8)
        assert r["fitted"] == pytest.approx(design(row) @ beta + effects[row[0]], abs=1e-8)


def test_contrasts_and_invariance(spark, frame):
    fit = op.additive_surface_fit(frame, SPEC, 0.1)
    got = {r["contrast"]: r["estimate"] for r in op.surface_contrasts(spark, fit).collect()}
    beta = fit.coefficients["all"]
    at = lambda p, q: np.outer(hats(p, SPEC.knots), hats(q, SPEC.knots)).ravel() @ beta[:9]
    assert got["A_minus_B"] == pytest.approx(at(0.75, 0.25) - at(0.75, 0.5))
    assert got["P_high_minus_mid_R50"] == pytest.approx(at(0.75, 0.5) - at(0.5, 0.5))
    rows = op.contrast_invariance(frame, fit).collect()
    assert len(rows) == 3 * 2 * 3 and max(abs(r["difference_from_main"]) for r in rows) < 1e-8


@pytest.mark.parametrize("block", [3, 1024])
def test_bootstrap_equals_refitting_copies(frame, panel, block):
    rho, reps = 0.2, 4
    got = {r["rep"]: r for r in op.contrast_bootstrap(frame, SPEC, rho, reps, 5, block=block).collect()}
    sites = by_site(panel)
    m = op.contrast_matrix(SPEC)
    for rep in range(1, reps + 1):
        drawn = [sites[int(hashlib.md5(f"5:{rep}:{pos}".encode()).hexdigest()[:15], 16) % len(sites)] for pos in range(len(sites))]
        beta, _ = full_solve(drawn, rho)
        for name, value in zip(op.CONTRAST_NAMES, m @ beta):
            assert got[rep][name] == pytest.approx(value, abs=1e-7)
        assert got[rep]["success"]


def test_leave_one_year_out_refit(frame, panel):
    fit = op.additive_surface_fit(frame, SPEC, 0.3)
    got = {int(r["omitted_year"]): r["estimate"] for r in op.loyo_refit(frame, SPEC, 0.3, list(SPEC.years), fit).collect()}
    for y in SPEC.years:
        beta, _ = full_solve(by_site([r for r in panel if r[1] != y]), 0.3)
        assert got[y] == pytest.approx(op.contrast_matrix(SPEC)[-1] @ beta, abs=1e-7)


def test_sensitivity_domains_in_one_job(frame, panel):
    other = replace(SPEC, response="r2", b=(0.75, 0.75))
    doubled = frame.withColumn("r2", 2 * F.col("r"))
    analyses = [op.Analysis("all", F.lit(True), SPEC), op.Analysis("early", F.col("year") < 2002, SPEC), op.Analysis("other", F.lit(True), other)]
    got = {r["analysis"]: r for r in op.sensitivity_suite(doubled, analyses, 0.1).collect()}
    for name, rows in (("all", panel), ("early", [r for r in panel if r[1] < 2002])):
        beta, _ = full_solve(by_site(rows), 0.1)
        assert got[name]["estimate"] == pytest.approx(op.contrast_matrix(SPEC)[-1] @ beta, abs=1e-7) and got[name]["n"] == len(rows)
    beta, _ = full_solve(by_site(panel), 0.1)
    assert got["other"]["estimate"] == pytest.approx(2 * (op.contrast_matrix(other)[-1] @ beta), abs=1e-7) and got["other"]["response"] == "r2"


def test_bootstrap_blocks_and_attempts(frame):
    whole = {r["rep"]: r for r in op.contrast_bootstrap(frame, SPEC, 0.1, 6, 5).collect()}
    cut = {r["rep"]: r for r in op.contrast_bootstrap(frame, SPEC, 0.1, 6, 5, block=2).collect()}
    assert set(whole) == set(cut) == set(range(1, 7))
    for k in whole:
        assert whole[k]["n"] == cut[k]["n"] and whole[k]["category"] == "NONE" and whole[k]["A_minus_B"] == pytest.approx(cut[k]["A_minus_B"], abs=1e-9)
    used, ledger = op.bootstrap_attempts(frame, SPEC, 0.1, 4, 6, 5)
    row = ledger.first()
    assert used.count() == 4 and row["attempts"] == 4 and row["target_reached"] and row["verdict"] == "PASS_CONTINUE"


def test_forest_learns_a_step_and_names_its_depth(spark):
    rows = [([float(i % 50), float(i % 7)], float(i % 50 >= 25)) for i in range(600)]
    df = spark.createDataFrame(rows, "f array<double>, y double")
    got = {(r["max_depth"], r["min_samples_leaf"]): r for r in op.random_forest_grid(df, df, "f", "y", [8], [None, 40, 2], [3]).collect()}
    assert {k[0]: r["built_depth"] for k, r in got.items()} == {"None": 30, "40": 30, "2": 2}
    assert all(r["n"] == 600 and r["rmse"] < 0.3 for r in got.values())


def test_rho_health_reference_and_grid(frame):
    fit, post = op.estimate_rho(frame, SPEC)
    r = post.first()
    assert abs(r["rho_used"]) < 0.9 and r["flag"] in ("PASS", "WARN", "STOP") and fit.rho == r["rho_used"]
    h = op.fit_health(frame, fit).first()
    assert h["nonfinite_fitted"] == 0 and h["n_coefficients"] == SPEC.width and h["status"] in ("PASS", "WARN")
    ref = op.reference_row(frame, SPEC).first()
    values = [x["c"] for x in frame.select("c").collect()]
    assert ref["c"] == pytest.approx(np.median(values)) and ref["month"] == 1 and ref["year"] == 2000
    grid = op.surface_grid_predict(frame, fit, 5)
    assert grid.count() == 25


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(80, 4)) + 5, rng.normal(size=80)
    y = x @ [1.0, -2.0, 0.0, 0.5] + 3 + noise
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, f array<double>, y double").repartition(6)
    alphas = [0.1, 10.0, 1e5]
    train, val = df.where("i < 60"), df.where("i >= 60")
    got = {r["alpha"]: r for r in op.ridge_grid(train, val, "f", "y", alphas).collect()}
    xc, yc = x[:60] - x[:60].mean(axis=0), y[:60] - y[:60].mean()
    rmse = {}
    for a in alphas:
        b = np.linalg.solve(xc.T @ xc + a * np.eye(4), xc.T @ yc)
        pred = (x[60:] - x[:60].mean(axis=0)) @ b + y[:60].mean()
        rmse[a] = np.sqrt(((pred - y[60:]) ** 2).mean())
        assert got[a]["rmse"] == pytest.approx(rmse[a], rel=1e-9)
    assert [a for a in alphas if got[a]["selected"]] == [min(rmse, key=rmse.get)]


def test_folds_keep_held_out_sites_apart(spark):
    df = spark.createDataFrame([(s, s % 2, y) for s in range(4) for y in (2005, 2019, 2022)], "site int, fold int, year int")
    out = op.spatial_folds(df, "fold", [0, 1], (2005, 2018), (2019, 2021), (2022, 2025))
    got = {(r["held_out"], r["role"]): r["count"] for r in out.groupBy("held_out", "role").count().collect()}
    assert got == {(h, r): 2 for h in (0, 1) for r in ("train", "val", "test")}
    assert out.where("(role = 'test') <> (fold = held_out)").count() == 0


@pytest.mark.parametrize("rows", [3, 1000])
def test_sensitivity_analyses_share_one_pass(spark, frame, panel, rows):
    wide = frame.withColumn("r2", F.when(F.col("site") % 2 == 0, 2 * F.col("r"))).withColumn("extra", F.when(F.col("month") != 2, F.col("c")))
    more = replace(SPEC, controls={**SPEC.controls, "extra": (-1.0, 0.0, 1.0)})
    analyses = [op.Analysis("all", F.lit(True), SPEC), op.Analysis("none", F.lit(None).cast("boolean"), SPEC), op.Analysis("even", F.lit(True), replace(SPEC, response="r2")),
                op.Analysis("late", F.col("year") > 2000, SPEC), op.Analysis("more", F.lit(True), more)]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, passes = spark.conf.get(setting), []
    spark.conf.set(setting, str(rows))
    spread, op._add_cells = op._add_cells, lambda parts, by: passes.append(by) or spread(parts, by)
    try:
        got = {r["analysis"]: r for r in op.sensitivity_suite(wide, analyses, 0.2).collect()}
    finally:
        op._add_cells = spread
        spark.conf.set(setting, before)
    assert passes == ["analysis"]  # whatever the number of specifications
    assert set(got) == {"all", "even", "late", "more"} and got["more"]["n"] == sum(r[2] != 2 for r in panel)
    for name, kept, scale in (("all", panel, 1), ("even", [r for r in panel if r[0] % 2 == 0], 2), ("late", [r for r in panel if r[1] > 2000], 1)):
        beta, _ = full_solve(by_site(kept), 0.2)
        assert got[name]["n"] == len(kept) and got[name]["estimate"] == pytest.approx(scale * (op.contrast_matrix(SPEC)[-1] @ beta), abs=1e-7)
    alone = op.additive_surface_fit(wide.where("extra is not null"), more, 0.2)
    assert got["more"]["estimate"] == pytest.approx(float(op.contrast_matrix(more)[-1] @ alone.coefficients["all"]), abs=1e-7)
