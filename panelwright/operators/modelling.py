"""The data-parallel part of model comparison.

Spark reduces the data to Gram matrices whose size depends on the number of columns only; the
small solves happen on those.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions import classify_message, finite, safe_divide, to_long
from panelwright.operators.checks import expect_finite, expect_same_keys, expect_unique
from panelwright.operators.forest import BLOCK, forest_predictions
from panelwright.operators.gram import gram_table, predict_levels, rows_to_matrix, sliced, solve_ridge
from panelwright.operators.metrics import METRICS, attempt_ledger, cluster_sufficient_stats, grid_winner, metrics_from_sums, regression_metrics, select_best
from panelwright.operators.ordering import exact_quantiles
from panelwright.operators.resampling import metrics_long, multi_seed_bootstrap, percentile_interval, replicate_counts
from panelwright.operators.temporal import attach_row, lag1_autocorrelation, section_starts
from panelwright.session import cut_lineage

# --- folds, selection and out-of-fold predictions -------------------------------------------

def spatial_folds(
    df: DataFrame, fold: str, folds: Sequence[int], train: tuple[int, int], validation: tuple[int, int], test: tuple[int, int], year: str = "year"
) -> DataFrame:
    """One table for all folds: `held_out` and the role a row plays for it. Rows without a role are dropped."""
    y, other = F.col(year), F.col(fold) != F.col("held_out")
    role = (
        F.when(other & y.between(*train), "train").when(other & y.between(*validation), "val").when(~other & y.between(*test), "test")
    )
    spread = df.withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in folds])))
    return spread.withColumn("role", role).where(F.col("role").isNotNull())


def nested_fold_selection(scores: DataFrame, fold: str, candidate: str, score: str, fixed: object) -> DataFrame:
    """Per fold the selected candidate (arm 'nested') beside the fixed one (arm 'fixed')."""
    best = select_best(scores, candidate, score, [fold])
    arms = F.array_compact(F.array(F.when(F.col("selected"), F.lit("nested")), F.when(F.col(candidate) == F.lit(fixed), F.lit("fixed"))))
    return best.withColumn("arm", F.explode(arms)).select(fold, "arm", candidate, "n_scores", "mean", "median")


def oof_predict(predictions: DataFrame, chosen: DataFrame, fold: str, candidate: str) -> DataFrame:
    """Held-out predictions of the chosen candidate of every fold and arm. `chosen` has folds x arms rows."""
    return predictions.join(F.broadcast(chosen.select(fold, candidate, "arm")), [fold, candidate])


def oof_violations(oof: DataFrame, cohort: DataFrame, keys: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """Duplicates, non-finite values and coverage of an out-of-fold table in one violation table."""
    by = ["arm", "seed", *keys]
    seeds = expect_unique(oof, by).unionByName(expect_finite(oof, ["y_true", "y_pred"]))
    return seeds.unionByName(expect_same_keys(oof, "arm", arms, cohort, keys))


def cv_bootstrap_compare(
    oof: DataFrame, cluster: str, reference: str, candidate: str, reps: int, seed: int, arm: str = "arm", model_seed: str = "seed"
) -> DataFrame:
    """Paired site-cluster bootstrap of two arms, metrics averaged over seeds, with relative difference."""
    stats = cluster_sufficient_stats(oof, [cluster, arm, model_seed])
    sums = [c for c in stats.columns if c not in (cluster, arm, model_seed)]
    total = stats.groupBy(arm, model_seed).agg(*[F.sum(c).alias(c) for c in sums])
    point = metrics_long(metrics_from_sums(total, [arm, model_seed]).groupBy(arm).agg(*[F.avg(m).alias(m) for m in METRICS]), [arm])
    draws = metrics_long(multi_seed_bootstrap(stats, [cluster], reps, seed, model_seed, [arm]), ["rep", arm])

    def side(name: str) -> Column:
        return F.max(F.when(F.col(arm) == name, F.col("value")))

    wide = point.groupBy("metric").agg(side(reference).alias("reference"), side(candidate).alias("candidate"))
    diffs = draws.groupBy("rep", "metric").agg((side(candidate) - side(reference)).alias("difference"))
    out = wide.join(percentile_interval(diffs, ["metric"], "difference"), "metric")
    d = F.col("candidate") - F.col("reference")
    return out.withColumn("difference", d).withColumn("relative_percent", F.lit(100.0) * safe_divide(d, F.abs(F.col("reference"))))


def prediction_frame(index: DataFrame, predictions: DataFrame, keys: Sequence[str], model: str, seed: int | None, extra: Mapping[str, object] | None = None) -> DataFrame:
    """Keys, truth, prediction and constants; every index row appears, so a missing prediction shows as null."""
    out = index.select(*keys, "y_true").join(predictions.select(*keys, "y_pred"), list(keys), "left")
    constants = {"model": model, "seed": seed, **(extra or {})}
    return out.withColumns({k: F.lit(v).cast("int") if k == "seed" else F.lit(v) for k, v in constants.items()})


# --- ridge ----------------------------------------------------------------------------------

def linear_predict(df: DataFrame, features: str, coefficients: Sequence[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """(keep, candidate, y_pred) for several coefficient vectors in one pass over the features."""
    matrix = np.stack(coefficients, axis=1)
    kept = df.select(*keep, features)
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keep).schema) + ", candidate int, y_pred double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch[features].to_numpy())
                y = x @ matrix[1:] + matrix[0]
                head = batch[list(keep)]
                for j in range(y.shape[1]):
                    yield head.assign(candidate=np.int32(j + 1), y_pred=y[:, j])

    return kept.mapInPandas(run, out_schema)


def _ridge_scores(train: np.ndarray, validation: DataFrame, features: str, target: str, alphas: Sequence[float]) -> DataFrame:
    preds = linear_predict(validation.withColumn("y_true", F.col(target)), features, [solve_ridge(train, a) for a in alphas], ["y_true"])
    table = regression_metrics(preds, ["candidate"])
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("candidate"))
    # as many rows as penalties
    order = Window.partitionBy(F.lit(0)).orderBy("rmse", "mae", "candidate")
    return table.withColumn("alpha", alpha).withColumn("selected", F.row_number().over(order) == 1)


def ridge_grid(train: DataFrame, validation: DataFrame, features: str, target: str, alphas: Sequence[float]) -> DataFrame:
    """Validation metrics per penalty: one Gram pass over train, one prediction pass over validation."""
    return _ridge_scores(gram_table(train, features, target, []).total(), validation, features, target, alphas)


def ridge_refit(
    df: DataFrame, role: str, features: str, target: str, alphas: Sequence[float], keep: Sequence[str],
    arms: Mapping[str, Sequence[str]] = MappingProxyType({"train": ("train",), "train_val": ("train", "val")}),
) -> DataFrame:
    """Test predictions of the selected penalty: (keep, arm, y_true, y_pred, alpha).

    `role` is train, val or test. One Gram pass over train and validation; the penalty is chosen as in `ridge_grid`; an
    arm is refitted on the sum of its roles' matrices. No row of the test role enters a fit.
    """
    grams = gram_table(df.where(F.col(role) != "test"), features, target, [role])
    part = {"train": grams.total(lambda **k: k[role] == "train")}
    best = _ridge_scores(part["train"], df.where(F.col(role) == "val"), features, target, alphas).where("selected").first()["alpha"]
    fits = {("test", arm): solve_ridge(grams.total(lambda **k: k[role] in roles), best) for arm, roles in arms.items()}
    test = df.where(F.col(role) == "test").withColumn("y_true", F.col(target).cast("double"))
    return predict_levels(test, features, role, fits, [*keep, "y_true"], "arm").withColumn("alpha", F.lit(float(best)))


# --- random forest --------------------------------------------------------------------------

def random_forest_grid(
    train: DataFrame, validation: DataFrame, features: str, target: str, trees: Sequence[int], depths: Sequence[int | None],
    leaves: Sequence[int], seed: int = 42, keys: Sequence[str] = (), block: int = BLOCK,
) -> DataFrame:
    """Validation metrics of every setting with the distributed forest, the winner marked `selected`.

    A forest predicts the mean of its trees, so a smaller forest is the first trees of the largest one, and a shallower
    tree is a deeper one cut off: every tree is grown once per size of leaves. Depth ends at 30 (`built_depth` is the depth
    that was built).
    Of equal squared errors the one with fewer trees wins, then the one of smaller depth (unlimited last), then the one of
    larger leaves.
    """
    built = sorted({min(d or 30, 30) for d in depths})
    each = forest_predictions(train, validation, features, target, max(trees), built, sorted(set(leaves)), seed, keys, block)

    def mean(t: int, depth: int, leaf: int) -> Column:
        mine = (F.col("tree") < t) & (F.col("leaf") == leaf)
        return F.sum(F.when(mine, F.get("p", F.lit(built.index(depth))))) / F.lit(float(t))

    shapes = [(t, d, leaf) for t in sorted(set(trees)) for d in built for leaf in sorted(set(leaves))]
    va = each.groupBy("id").agg(F.max("y_true").alias("y_true"), *[mean(*s).alias(f"_p{i}") for i, s in enumerate(shapes)])
    # as many rows per row as settings
    settings = [
        F.struct(
            F.lit(t).alias("n_estimators"), F.lit(str(d)).alias("max_depth"), F.lit(min(d or 30, 30)).alias("built_depth"), F.lit(leaf).alias("min_samples_leaf"),
            F.col(f"_p{shapes.index((t, min(d or 30, 30), leaf))}").alias("y_pred"),
        )
        for t in sorted(trees) for d in depths for leaf in leaves
    ]
    keys = ["n_estimators", "max_depth", "built_depth", "min_samples_leaf"]
    table = cut_lineage(regression_metrics(va.select("y_true", F.inline(F.array(*settings))), keys))
    depth = F.when(F.col("max_depth") == "None", None).otherwise(F.col("max_depth").cast("int"))
    best = grid_winner(table.withColumn("_all", F.lit(0)), ["_all"], "rmse", [F.col("n_estimators").asc(), depth.asc_nulls_last(), F.col("min_samples_leaf").desc()])
    return table.join(F.broadcast(best.select(*keys, "tie", F.lit(True).alias("selected"))), keys, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))  # one row


# --- additive surface model -----------------------------------------------------------------

@dataclass(frozen=True)
class AdditiveSpec:
    """response ~ surface(x, y) + smooth controls + month + year + entity intercept, AR(1) errors.

    `y_knots` are the surface's knots along y where they differ from those along x; `a` and `b` are the two positions of
    the main contrast. Both serve exposures that are not ranks.
    """

    response: str
    x: str
    y: str
    knots: tuple[float, ...]
    controls: Mapping[str, tuple[float, ...]]
    months: tuple[int, ...]
    years: tuple[int, ...]
    site: str
    time: str
    ridge: float = 1e-3
    site_ridge: float = 1.0
    y_knots: tuple[float, ...] | None = None
    a: tuple[float, float] = (0.75, 0.25)
    b: tuple[float, float] = (0.75, 0.50)

    @property
    def knots_of_y(self) -> tuple[float, ...]:
        return self.y_knots or self.knots

    @property
    def width(self) -> int:
        return len(self.knots) * len(self.knots_of_y) + sum(len(k) - 1 for k in self.controls.values()) + len(self.months) - 1 + len(self.years) - 1


@dataclass
class AdditiveFit:
    """Coefficients per analysis level; `None` is the only level of an ungrouped fit."""

    spec: AdditiveSpec
    rho: float
    coefficients: dict[object, np.ndarray]
    rank: dict[object, int] = field(default_factory=dict)


def hat_basis(column: str, knots: Sequence[float]) -> list[Column]:
    """Piecewise-linear basis; the value is held constant outside the knots."""
    v = F.least(F.greatest(F.col(column), F.lit(knots[0])), F.lit(knots[-1]))
    out = []
    for i, k in enumerate(knots):
        sides = []
        if i > 0:
            sides.append((v - knots[i - 1]) / (k - knots[i - 1]))
        if i < len(knots) - 1:
            sides.append((knots[i + 1] - v) / (knots[i + 1] - k))
        out.append(F.greatest(F.least(*sides) if len(sides) > 1 else sides[0], F.lit(0.0)))
    return out


def design_vector(spec: AdditiveSpec) -> Column:
    """All basis columns of a row as one array, built by projection."""
    hx, hy = hat_basis(spec.x, spec.knots), hat_basis(spec.y, spec.knots_of_y)
    cols = [a * b for a in hx for b in hy]
    for c, knots in spec.controls.items():
        cols += hat_basis(c, knots)[1:]
    cols += [(F.col("month") == m).cast("double") for m in spec.months[1:]]
    cols += [(F.col("year") == y).cast("double") for y in spec.years[1:]]
    return F.array(*cols)


def whitened_design(df: DataFrame, spec: AdditiveSpec, rho: float, by: Sequence[str] = ()) -> DataFrame:
    """Design, response and intercept after removing AR(1) correlation inside each section."""
    keys = [*by, spec.site]
    rows = section_starts(df, keys, spec.time).withColumn("_x", design_vector(spec)).withColumn("_y", F.col(spec.response).cast("double"))
    if rho == 0.0:
        return rows.withColumn("_wx", F.col("_x")).withColumn("_wy", F.col("_y")).withColumn("_u", F.lit(1.0))
    w = Window.partitionBy(*keys).orderBy(spec.time)
    s = float(np.sqrt(1.0 - rho * rho))
    rows = rows.withColumn("_px", F.lag("_x").over(w)).withColumn("_py", F.lag("_y").over(w))
    first = F.col("section_start")
    return (
        rows.withColumn("_wx", F.when(first, F.col("_x")).otherwise(F.zip_with("_x", F.coalesce("_px", "_x"), lambda a, b: (a - F.lit(rho) * b) / F.lit(s))))
        .withColumn("_wy", F.when(first, F.col("_y")).otherwise((F.col("_y") - F.lit(rho) * F.col("_py")) / F.lit(s)))
        .withColumn("_u", F.when(first, F.lit(1.0)).otherwise(F.lit((1.0 - rho) / s)))
        .drop("_px", "_py")
    )


def site_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, columns) of consecutive rows with equal keys, across batches; one run is held at a time.

    Arrays of doubles become matrices without objects.
    """
    held: list[dict[str, np.ndarray]] = []
    last: tuple = ()

    def whole() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = [c for c in batch.schema.names if c not in keys]
        columns = {c: rows_to_matrix(batch.column(c)) if pa.types.is_list(batch.schema.field(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        levels = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        cuts = [0, *[i for i in range(1, len(levels)) if levels[i] != levels[i - 1]], len(levels)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and levels[start] != last:
                yield last, whole()
                held = []
            last = levels[start]
            held.append({c: v[start:stop] for c, v in columns.items()})
    if held:
        yield last, whole()


def _entity_rows(df: DataFrame, spec: AdditiveSpec, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Rows of (design, response, 1) laid together by entity in time order: the one layout every fit needs."""
    keys = [*by, spec.site]
    v = F.concat(design_vector(spec), F.array(F.col(spec.response).cast("double"), F.lit(1.0)))
    return df.select(*keys, F.col(spec.time).cast("long").alias("_t"), *extra, v.alias("_v")).repartition(*keys).sortWithinPartitions(*keys, "_t")


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def site_moments(df: DataFrame, spec: AdditiveSpec, by: Sequence[str] = ()) -> DataFrame:
    """Per entity: n and four moment matrices of its rows v = (design, response, 1), one after another.

    With t a row and s its predecessor in the same section: the sums of tt' over section starts, and of tt', ts' and ss'
    over the others. The Gram matrix whitened with any autocorrelation, and the lagged products of any residual, follow
    from them, so one pass over the rows serves every fit. An entity's rows are one calendar; its moments do not grow.
    """
    keys = [*by, spec.site]
    rows = _entity_rows(df, spec, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = None
        for key, run_ in site_runs(batches, keys):
            v, t = run_["_v"], run_["_t"]
            joined = np.flatnonzero(np.diff(t) <= 1) + 1
            first = np.ones(len(t), bool)
            first[joined] = False
            now, before = v[joined], v[joined - 1]
            m = np.concatenate([(x.T @ y).ravel() for x, y in ((v[first], v[first]), (now, now), (now, before), (before, before))])
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key)) | {"n": len(t), "moments": m}], schema=fields)

    return rows.mapInArrow(_typed(run, rows, keys, [("n", pa.int64()), ("moments", pa.list_(pa.float64()))]), _key_schema(rows, keys) + ", n long, moments array<double>")


def _typed(run, rows: DataFrame, keys: Sequence[str], more: Sequence[tuple[str, pa.DataType]]):
    """`run` with the rows it yields cast to the keys' own types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(rows.select(*keys).schema)] + [pa.field(n, k) for n, k in more])

    def typed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return typed


def whitened_moments(moments: np.ndarray, width: int, rho: float) -> np.ndarray:
    """(entities, width + 2, width + 2): moments of the rows whitened with `rho`."""
    q = width + 2
    first, now, cross, before = np.moveaxis(moments.reshape(-1, 4, q, q), 1, 0)
    return first + (now - rho * (cross + cross.transpose(0, 2, 1)) + rho * rho * before) / (1.0 - rho * rho)


def absorbed(w: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, cross, z, uy, uu) of whitened moments, the penalised intercept taken out of gram and cross."""
    z, uy, uu = w[:, :-2, -1], w[:, -2, -1], w[:, -1, -1]
    scale = uu + penalty
    gram = w[:, :-2, :-2] - z[:, :, None] * z[:, None, :] / scale[:, None, None]
    cross = w[:, :-2, -2] - z * (uy / scale)[:, None]
    return gram, cross, z, uy, uu


def grams_at(moments: DataFrame, spec: AdditiveSpec, rho: float, by: Sequence[str] = ()) -> DataFrame:
    """Per entity: its Gram matrix and cross-product with its own penalised intercept absorbed; a map over the moments.

    Absorbed matrices simply add up over entities and over bootstrap copies.
    """
    keys, width, penalty = [*by, spec.site], spec.width, spec.site_ridge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in sliced(batches):
            gram, cross, z, uy, uu = absorbed(whitened_moments(rows_to_matrix(batch.column("moments")), width, rho), penalty)
            cells = [pa.array(list(a.reshape(len(a), -1)), kind) for a in (gram, cross, z)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("n"), *cells, pa.array(uy), pa.array(uu)], names=[*keys, "n", "gram", "cross", "z", "uy", "uu"])

    return moments.select(*keys, "n", "moments").mapInArrow(run, _key_schema(moments, keys) + ", n long, gram array<double>, cross array<double>, z array<double>, uy double, uu double")


def site_grams(df: DataFrame, spec: AdditiveSpec, rho: float, by: Sequence[str] = ()) -> DataFrame:
    """Absorbed matrices per entity straight from the rows."""
    return grams_at(site_moments(df, spec, by), spec, rho, by)


def _add_cells(parts: DataFrame, by: str) -> dict[object, np.ndarray]:
    """Sum of the arrays `_g` per level on Spark, cell by cell; levels are few and arrays model-sized."""
    out: dict[object, dict[int, float]] = {}
    for r in parts.select(by, F.posexplode("_g").alias("pos", "v")).groupBy(by, "pos").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r[by], {})[r["pos"]] = r["v"]
    return {k: np.array([cell[i] for i in range(len(cell))]) for k, cell in out.items()}


def _split(flat: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    return flat[: p * p].reshape(p, p), flat[p * p : p * p + p]


def _sum_grams(grams: DataFrame, by: str | None, p: int) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """Total Gram and cross-product per level: summed per task, then per matrix cell on Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[object, np.ndarray] = {}
        for batch in sliced(batches):
            g, levels = rows_to_matrix(batch.column("_g")), np.array(batch.column("_by").to_pylist(), object)
            for level in dict.fromkeys(levels.tolist()):
                acc[level] = acc.get(level, 0.0) + g[levels == level].sum(axis=0)
        for level, g in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.string()), pa.array([g], pa.list_(pa.float64()))], names=["_by", "_g"])

    level = F.lit("all") if by is None else F.col(by).cast("string")
    rows = grams.select(level.alias("_by"), F.concat("gram", "cross").alias("_g")).mapInArrow(partial, "_by string, _g array<double>")
    return {k: _split(flat, p) for k, flat in _add_cells(rows, "_by").items()}


def fit_moments(moments: DataFrame, spec: AdditiveSpec, rho: float = 0.0, by: str | None = None) -> AdditiveFit:
    """Fit one model per `by` level from the entities' moments; the rows are not read."""
    totals = _sum_grams(grams_at(moments, spec, rho, [by] if by else []), by, spec.width)
    fit = AdditiveFit(spec, rho, {})
    for level, (gram, cross) in totals.items():
        fit.coefficients[level] = np.linalg.solve(gram + spec.ridge * np.eye(len(cross)), cross)
        fit.rank[level] = int(np.linalg.matrix_rank(gram))
    return fit


def additive_surface_fit(df: DataFrame, spec: AdditiveSpec, rho: float = 0.0, by: str | None = None) -> AdditiveFit:
    """Fit one model per `by` level in one job."""
    return fit_moments(site_moments(df, spec, [by] if by else []), spec, rho, by)


def _dot(column: str, beta: np.ndarray) -> Column:
    literal = F.array(*[F.lit(float(b)) for b in beta])
    return F.aggregate(F.zip_with(F.col(column), literal, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def residuals(df: DataFrame, fit: AdditiveFit, moments: DataFrame | None = None) -> DataFrame:
    """Fitted value, residual and whitened residual per row of an ungrouped fit; `moments` spares a pass over the rows."""
    spec, beta = fit.spec, fit.coefficients["all"]
    grams = grams_at(site_moments(df, spec) if moments is None else moments, spec, fit.rho).select(
        spec.site, ((F.col("uy") - _dot("z", beta)) / (F.col("uu") + F.lit(spec.site_ridge))).alias("site_effect")
    )
    rows = whitened_design(df, spec, fit.rho).join(grams, spec.site)
    return (
        rows.withColumn("fitted", _dot("_x", beta) + F.col("site_effect")).withColumn("residual", F.col("_y") - F.col("fitted"))
        .withColumn("std_residual", F.col("_wy") - _dot("_wx", beta) - F.col("_u") * F.col("site_effect"))
        .drop("_x", "_y", "_wx", "_wy", "_u", "section", "section_start")
    )


def residual_correlation(moments: DataFrame, fit: AdditiveFit) -> float | None:
    """Lag-1 correlation of an ungrouped fit's residuals over consecutive rows, from the moments alone; null without variance."""
    spec, beta, rho = fit.spec, fit.coefficients["all"], fit.rho
    q, names = spec.width + 2, ["n", "a", "b", "aa", "bb", "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            m = rows_to_matrix(batch.column("moments"))
            _, _, z, uy, uu = absorbed(whitened_moments(m, spec.width, rho), spec.site_ridge)
            e = np.column_stack([np.tile(np.append(-beta, 1.0), (len(m), 1)), -(uy - z @ beta) / (uu + spec.site_ridge)])
            _, now, cross, before = np.moveaxis(m.reshape(-1, 4, q, q), 1, 0)
            form = [np.einsum("ei,eij,ej->e", e, x, e) for x in (now, before, cross)]
            sums = [now[:, -1, -1], np.einsum("ej,ej->e", now[:, -1], e), np.einsum("ej,ej->e", before[:, -1], e), *form]
            yield pa.RecordBatch.from_arrays([pa.array([float(x.sum())]) for x in sums], names=names)

    rows = moments.select("moments").mapInArrow(run, ", ".join(f"{n} double" for n in names))
    n, a, b, aa, bb, ab = rows.agg(*[F.sum(c) for c in names]).first()
    spread = 0.0 if not n else (aa - a * a / n) * (bb - b * b / n)
    return (ab - a * b / n) / spread**0.5 if spread > 0 else None


def estimate_rho(df: DataFrame, spec: AdditiveSpec, extreme: float = 0.90) -> tuple[AdditiveFit, DataFrame]:
    """Independent fit, residual lag-1 correlation, one refit with that fixed rho, and its post-fit check."""
    fit, moments = fit_with_rho(df, spec, extreme)
    post = lag1_autocorrelation(residuals(df, fit, moments), [spec.site], spec.time, "std_residual").withColumnRenamed("rho", "lag1")
    flag = F.when(F.abs("lag1") <= 0.10, "PASS").when(F.abs("lag1") <= 0.20, "WARN").otherwise("STOP")
    return fit, post.withColumn("rho_used", F.lit(float(fit.rho))).withColumn("flag", flag)


def fit_with_rho(df: DataFrame, spec: AdditiveSpec, extreme: float = 0.90) -> tuple[AdditiveFit, DataFrame]:
    """(fit with its estimated autocorrelation, moments): one pass over the rows; both fits and the correlation read moments."""
    moments = cut_lineage(site_moments(df, spec))
    rho = residual_correlation(moments, fit_moments(moments, spec))
    if rho is None or abs(rho) >= extreme:
        raise ValueError(f"unusable autocorrelation: {rho}")
    return fit_moments(moments, spec, float(rho)), moments


# Seven positions in rank space and the six differences between them (end - start), the axis each moves along
# and whether it is exploratory.
POSITIONS = [(1, 0.25, 0.50), (2, 0.50, 0.25), (3, 0.50, 0.50), (4, 0.50, 0.75), (5, 0.75, 0.25), (6, 0.75, 0.50), (7, 0.25, 0.75)]
CONTRASTS = [
    ("P_mid_minus_low_R50", 1, 3, "x", False),
    ("P_high_minus_mid_R50", 3, 6, "x", False),
    ("P_mid_minus_low_R75", 7, 4, "x", True),
    ("R_mid_minus_low_P50", 2, 3, "y", False),
    ("R_high_minus_mid_P50", 3, 4, "y", False),
    ("R_mid_minus_low_P75", 5, 6, "y", False),
]


def surface_at(spec: AdditiveSpec, x: float, y: float) -> np.ndarray:
    """Design vector of a surface position with every other term at zero; enough for contrasts."""
    def hats(v: float, knots: Sequence[float]) -> np.ndarray:
        return np.array([np.interp(v, knots, row) for row in np.eye(len(knots))])

    out = np.zeros(spec.width)
    surface = np.outer(hats(x, spec.knots), hats(y, spec.knots_of_y)).ravel()
    out[: len(surface)] = surface
    return out


def contrast_matrix(spec: AdditiveSpec) -> np.ndarray:
    """Rows: the six differences, then A - B."""
    at = {i: surface_at(spec, x, y) for i, x, y in POSITIONS}
    rows = [at[end] - at[start] for _, start, end, _, _ in CONTRASTS]
    return np.stack([*rows, surface_at(spec, *spec.a) - surface_at(spec, *spec.b)])


CONTRAST_NAMES = [c[0] for c in CONTRASTS] + ["A_minus_B"]


def surface_contrasts(spark: SparkSession, fit: AdditiveFit) -> DataFrame:
    """(analysis, contrast, variable, exploratory, estimate); seven rows per analysis level. A - B moves along y."""
    m = contrast_matrix(fit.spec)
    axis = {"x": fit.spec.x, "y": fit.spec.y}
    about = [(name, axis[moves], exploratory) for name, _, _, moves, exploratory in CONTRASTS] + [(CONTRAST_NAMES[-1], fit.spec.y, False)]
    rows = [(str(k), *who, float(v)) for k, b in sorted(fit.coefficients.items()) for who, v in zip(about, m @ b)]
    return spark.createDataFrame(rows, "analysis string, contrast string, variable string, exploratory boolean, estimate double")


def predict_rows(df: DataFrame, fit: AdditiveFit, level: object = "all") -> DataFrame:
    """Fixed-effect prediction of arbitrary covariate rows."""
    return df.withColumn("_x", design_vector(fit.spec)).withColumn("fitted", _dot("_x", fit.coefficients[level])).drop("_x")


def reference_rows(df: DataFrame, spec: AdditiveSpec, quantiles: Sequence[float]) -> DataFrame:
    """One row per quantile: that quantile of each control, the first month, year and entity, point A of the surface.

    All controls and quantiles come from one pass over the controls in long form.
    """
    names = list(spec.controls)
    probs = {f"q{i}": q for i, q in enumerate(quantiles)}
    found = exact_quantiles(to_long(df, [], names), "value", probs, by=["feature"])  # one row per control
    cells = [F.struct(F.lit(q).alias("control_quantile"), F.col(k).alias("_v")) for k, q in probs.items()]
    long = found.select("feature", F.inline(F.array(*cells)))
    wide = long.groupBy("control_quantile").agg(*[F.max(F.when(F.col("feature") == c, F.col("_v"))).alias(c) for c in names])
    first = df.agg(F.min("month").alias("month"), F.min("year").alias("year"), F.min(spec.site).alias(spec.site))
    return attach_row(wide, first).withColumn(spec.x, F.lit(spec.a[0])).withColumn(spec.y, F.lit(spec.a[1]))


def reference_row(df: DataFrame, spec: AdditiveSpec, quantile: float = 0.5) -> DataFrame:
    return reference_rows(df, spec, [quantile]).drop("control_quantile")


def contrast_invariance(df: DataFrame, fit: AdditiveFit, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A - B evaluated at several months, years and control quantiles; every value must agree."""
    spec = fit.spec
    refs = reference_rows(df, spec, quantiles)
    months = sorted({spec.months[0], spec.months[len(spec.months) // 2], spec.months[-1]})
    years = sorted({spec.years[0], spec.years[-1]})
    grid = refs.drop("month", "year").withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    grid = grid.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))

    def at(point: tuple[float, float]) -> DataFrame:
        return predict_rows(grid.withColumn(spec.x, F.lit(point[0])).withColumn(spec.y, F.lit(point[1])), fit)

    keys = ["month", "year", "control_quantile"]
    a = at(spec.a).select(*keys, F.col("fitted").alias("_a"))
    b = at(spec.b).select(*keys, F.col("fitted").alias("_b"))
    main = float((contrast_matrix(spec)[-1]) @ fit.coefficients["all"])
    return a.join(b, keys).select(*keys, (F.col("_a") - F.col("_b")).alias("contrast")).withColumn(
        "difference_from_main", F.col("contrast") - F.lit(main)
    )


def surface_grid_predict(df: DataFrame, fit: AdditiveFit, steps: int = 80) -> DataFrame:
    """Fitted surface on a regular grid at the reference covariates."""
    ref = reference_row(df, fit.spec).drop(fit.spec.x, fit.spec.y)
    axis = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / F.lit(float(steps - 1)))
    grid = ref.withColumn(fit.spec.x, F.explode(axis)).withColumn(fit.spec.y, F.explode(axis))
    return predict_rows(grid, fit).select(fit.spec.x, fit.spec.y, "fitted")


#: Replicates whose matrices travel as one row.
TOGETHER = 32


def contrast_bootstrap(df: DataFrame, spec: AdditiveSpec, rho: float, reps: int, seed: int, block: int = 512, moments: DataFrame | None = None) -> DataFrame:
    """Refit on `reps` site resamples: (rep, n, success, message, category, one column per contrast).

    A replicate's Gram matrix is the draw-weighted sum of the entity matrices. Every entity carries how often each
    replicate draws it; a task multiplies (replicates x entities) weights with its entities' matrices, `block` of them at a time,
    and adds everything it holds before the shuffle. What moves is replicates x cells per task, however many entities
    there are; replicates are added and solved in parallel. `moments` spares the pass over the rows.
    """
    p, ridge, names = spec.width, spec.ridge, CONTRAST_NAMES
    cells, m = p * p + p + 1, contrast_matrix(spec)
    grams = cut_lineage(grams_at(site_moments(df, spec) if moments is None else moments, spec, rho))  # read for the index and for the product
    drawn = replicate_counts(grams, [spec.site], reps, seed)
    flat = F.concat("gram", "cross", F.array(F.col("n").cast("double")))
    rows = grams.select(spec.site, flat.alias("_g")).join(drawn, spec.site).select("_g", "counts")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((reps, cells)), False
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part, used = batch.slice(at, block), True
                total += rows_to_matrix(part.column("counts")).astype(float).T @ rows_to_matrix(part.column("_g"))
        if used:
            for first in range(0, reps, TOGETHER):
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total[first : first + TOGETHER].ravel()], pa.list_(pa.float64()))], names=["first", "_g"])

    def solve(rep: int, flat: np.ndarray) -> dict[str, object]:
        row: dict[str, object] = {"rep": rep, "n": round(flat[-1]), "success": True, "message": ""} | dict.fromkeys(names)
        try:
            beta = np.linalg.solve(flat[: p * p].reshape(p, p) + ridge * np.eye(p), flat[p * p : -1])
        except np.linalg.LinAlgError as error:
            return row | {"success": False, "message": str(error)}
        if not np.isfinite(beta).all():
            return row | {"success": False, "message": "nonfinite coefficients"}
        return row | dict(zip(names, (float(v) for v in m @ beta)))

    kinds = pa.schema([("rep", pa.int32()), ("n", pa.int64()), ("success", pa.bool_()), ("message", pa.string()), *[(n, pa.float64()) for n in names]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, None
        for batch in batches:
            for i, f in enumerate(batch.column("first").to_pylist()):
                g = batch.column("_g")[i].values.to_numpy()
                if f != first and first is not None:
                    yield pa.RecordBatch.from_pylist([solve(first + k + 1, x) for k, x in enumerate(total.reshape(-1, cells))], schema=kinds)
                first, total = f, (g.copy() if f != first else total + g)
        if first is not None:
            yield pa.RecordBatch.from_pylist([solve(first + k + 1, x) for k, x in enumerate(total.reshape(-1, cells))], schema=kinds)

    sums = rows.mapInArrow(multiply, "first int, _g array<double>")
    schema = "rep int, n long, success boolean, message string, " + ", ".join(f"{n} double" for n in names)
    return sums.repartition("first").sortWithinPartitions("first").mapInArrow(finish, schema).withColumn("category", classify_message("message"))


def bootstrap_attempts(
    df: DataFrame, spec: AdditiveSpec, rho: float, target: int, limit: int, seed: int, moments: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(attempts used, their ledger): attempts run in order until `target` succeed, at most `limit`; see `attempt_ledger`."""
    attempts = cut_lineage(contrast_bootstrap(df, spec, rho, limit, seed, moments=moments))
    ledger = attempt_ledger(attempts, "rep", "success", "category", target)
    before = Window.orderBy("rep").rowsBetween(Window.unboundedPreceding, -1)  # one row per attempt: bounded by `limit`
    done = F.coalesce(F.sum(F.col("success").cast("int")).over(before), F.lit(0))
    return attempts.withColumn("_done", done).where(F.col("_done") < target).drop("_done"), ledger


def year_totals(df: DataFrame, spec: AdditiveSpec, rho: float, years: Sequence[int], year: str = "year") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Total Gram and cross-product with each year left out, from one pass over the rows for any number of years.

    An entity's moments without a year are its moments, less those of the rows in that year, less those of a row whose
    predecessor lies in it, plus what that row adds as the start of a section. Only years that an entity has make a
    difference, so a task keeps one total and one correction a year.
    """
    keys, p, penalty, s = [spec.site], spec.width, spec.site_ridge, float(np.sqrt(1.0 - rho * rho))
    rows = _entity_rows(df, spec, extra=[F.col(year).cast("long").alias("_year")])

    def flat(w: np.ndarray) -> np.ndarray:
        gram, cross, *_ = absorbed(w[None], penalty)
        return np.concatenate([gram.ravel(), cross.ravel()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, change = np.zeros(p * p + p), {y: np.zeros(p * p + p) for y in years}
        for _, run_ in site_runs(batches, keys):
            v, t, own = run_["_v"], run_["_t"], run_["_year"]
            joined = np.concatenate([[False], np.diff(t) <= 1])
            before = np.concatenate([v[:1], v[:-1]])
            w = np.where(joined[:, None], (v - rho * before) / s, v)
            full = w.T @ w
            kept = flat(full)
            whole += kept
            for y in set(own.tolist()) & change.keys():
                out = own == y
                after = joined & ~out & np.concatenate([[False], out[:-1]])
                change[y] += flat(full - w[out].T @ w[out] - w[after].T @ w[after] + v[after].T @ v[after]) - kept
        levels = [None, *years]
        yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int64()), pa.array([whole, *change.values()], pa.list_(pa.float64()))], names=["omitted", "_g"])

    found = _add_cells(rows.mapInArrow(run, "omitted long, _g array<double>"), "omitted")
    return {y: _split(found[None] + found[y], p) for y in years}


def loyo_refit(df: DataFrame, spec: AdditiveSpec, rho: float, years: Sequence[int], full: AdditiveFit) -> DataFrame:
    """A - B with each year left out: estimate, sign agreement and relative change from the full fit."""
    fit = AdditiveFit(spec, rho, {})
    for y, (gram, cross) in year_totals(df, spec, rho, years).items():
        fit.coefficients[y] = np.linalg.solve(gram + spec.ridge * np.eye(len(cross)), cross)
    main = float(contrast_matrix(spec)[-1] @ full.coefficients["all"])
    out = surface_contrasts(df.sparkSession, fit).where(F.col("contrast") == "A_minus_B").withColumnRenamed("analysis", "omitted_year")
    return (
        out.withColumn("same_sign", F.signum("estimate") == F.signum(F.lit(main)))
        .withColumn("relative_change", safe_divide(F.col("estimate") - F.lit(main), F.abs(F.lit(main))))
    )


@dataclass(frozen=True)
class Analysis:
    """One sensitivity analysis: its rows, and its own response, exposures and covariates."""

    name: str
    domain: Column
    spec: AdditiveSpec


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no key's rows lie in two of them; one batch and one key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        levels = batch.column(key).to_pylist()
        last = next((i + 1 for i in range(len(levels) - 2, -1, -1) if levels[i] != levels[-1]), 0)
        if last == 0 and (not held or held[0].column(key)[0].as_py() == levels[-1]):
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def domain_totals(df: DataFrame, analyses: Sequence[Analysis], rho: float) -> dict[int, np.ndarray]:
    """Per analysis, by its number: its Gram matrix, cross-product and number of rows, one after another; one pass for all.

    A row moves once, with the fields that any design needs and the analyses it belongs to; designs are built where it
    arrives. A task keeps one total per analysis, whatever the number of entities. All analyses share entity and time.
    """
    specs = [a.spec for i, a in enumerate(analyses) if a.spec not in [b.spec for b in analyses[:i]]]
    about = [(specs.index(a.spec), a.spec.width, a.spec.site_ridge) for a in analyses]
    site, time, s = specs[0].site, specs[0].time, float(np.sqrt(1.0 - rho * rho))
    needed = [c for c in dict.fromkeys(c for p in specs for c in (p.response, p.x, p.y, *p.controls, "month", "year")) if c != site]
    inside = []
    for a in analyses:
        use = F.coalesce(a.domain, F.lit(False))
        for c in (a.spec.response, a.spec.x, a.spec.y, *a.spec.controls):
            use = use & F.col(c).isNotNull()
        inside.append(use)
    rows = df.select(site, *needed, F.col(time).cast("long").alias("_t"), F.array(*inside).alias("_in")).where(F.exists("_in", lambda used: used))
    laid = rows.repartition(site).sortWithinPartitions(site, "_t")
    designs = [F.concat(design_vector(p), F.array(F.col(p.response).cast("double"), F.lit(1.0))).alias(f"_v{i}") for i, p in enumerate(specs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(width * (width + 1) + 1) for _, width, _ in about]
        for part in whole_keys(batches, "_k"):
            part = part.combine_chunks()
            level = part.column("_k").combine_chunks().dictionary_encode().indices.to_numpy()
            t, used = part.column("_t").to_numpy(), rows_to_matrix(part.column("_in").combine_chunks()).astype(bool)
            vectors = [rows_to_matrix(part.column(f"_v{i}").combine_chunks()) for i in range(1 + max(i for i, _, _ in about))]
            for j, (spec, _, penalty) in enumerate(about):
                mine = used[:, j]
                if not mine.any():
                    continue
                v, own, at = vectors[spec][mine], level[mine], t[mine]
                new = np.concatenate([[True], own[1:] != own[:-1]])
                joined = ~new & np.concatenate([[False], np.diff(at) <= 1])
                w = np.where(joined[:, None], (v - rho * np.concatenate([v[:1], v[:-1]])) / s, v)
                x, y, u = w[:, :-2], w[:, -2], w[:, -1]
                z = np.add.reduceat(w * u[:, None], np.flatnonzero(new), axis=0)
                z, uy, scale = z[:, :-2], z[:, -2], z[:, -1] + penalty
                gram, cross = x.T @ x - z.T @ (z / scale[:, None]), x.T @ y - z.T @ (uy / scale)
                totals[j] += np.concatenate([gram.ravel(), cross, [len(v)]])
        some = [j for j, g in enumerate(totals) if g[-1]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([totals[j] for j in some], pa.list_(pa.float64()))], names=["analysis", "_g"])

    return _add_cells(laid.select(F.col(site).alias("_k"), "_t", "_in", *designs).mapInArrow(run, "analysis int, _g array<double>"), "analysis")


def sensitivity_suite(df: DataFrame, analyses: Sequence[Analysis], rho: float) -> DataFrame:
    """The main contrast of every analysis that has rows: (analysis, response, n, estimate)."""
    out = []
    for site, time in dict.fromkeys((a.spec.site, a.spec.time) for a in analyses):
        mine = [a for a in analyses if (a.spec.site, a.spec.time) == (site, time)]
        for j, flat in sorted(domain_totals(df, mine, rho).items()):
            spec = mine[j].spec
            gram, cross = _split(flat, spec.width)
            beta = np.linalg.solve(gram + spec.ridge * np.eye(len(cross)), cross)
            out.append((mine[j].name, spec.response, round(flat[-1]), float(contrast_matrix(spec)[-1] @ beta)))
    return df.sparkSession.createDataFrame(out, "analysis string, response string, n long, estimate double")


def fit_health(df: DataFrame, fit: AdditiveFit) -> DataFrame:
    """One row: non-finite counts, rank against the number of coefficients, status."""
    beta = fit.coefficients["all"]
    r = residuals(df, fit)
    out = r.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~finite("fitted"), 1)).alias("nonfinite_fitted"),
        F.count(F.when(~finite("residual"), 1)).alias("nonfinite_residuals"),
    )
    out = out.withColumn("nonfinite_coefficients", F.lit(int((~np.isfinite(beta)).sum()))).withColumn("n_coefficients", F.lit(len(beta)))
    out = out.withColumn("rank", F.lit(fit.rank["all"]))
    bad = (F.col("nonfinite_fitted") > 0) | (F.col("nonfinite_residuals") > 0) | (F.col("nonfinite_coefficients") > 0)
    return out.withColumn("status", F.when(bad, "STOP").when(F.col("rank") < F.col("n_coefficients"), "WARN").otherwise("PASS"))
