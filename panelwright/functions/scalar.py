"""Column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month labels and the failure categories with the patterns that select them.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FAILURE_PATTERNS = [
    ("STRUCTURAL_ERROR", "object .* not found|length mismatch|factor has new level|contrasts can be applied|model frame|ar.start length|not strictly increasing"),
    ("NUMERICAL_IDENTIFIABILITY_FAILURE", "rank|identif|singular"),
    ("NONFINITE_RESULT", "nonfinite|non-finite|not finite|inf|nan"),
    ("CONVERGENCE_FAILURE", "converg|iteration"),
]
RANK_QUARTILE_LABELS = ["Q1_[0,0.25]", "Q2_(0.25,0.50]", "Q3_(0.50,0.75]", "Q4_(0.75,1]"]

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- calendar -------------------------------------------------------------------------------

def month_index(year: ColumnLike, month: ColumnLike) -> Column:
    """Linear month number; only differences matter."""
    return (_c(year) * 12 + _c(month) - 1).cast("int")


def index_year(period: ColumnLike) -> Column:
    return F.floor(_c(period) / 12).cast("int")


def index_month(period: ColumnLike) -> Column:
    return (F.pmod(_c(period), F.lit(12)) + 1).cast("int")


def add_months(year: ColumnLike, month: ColumnLike, k: ColumnLike | int) -> tuple[Column, Column]:
    """(year, month) shifted by `k` months."""
    shifted = month_index(year, month) + (F.lit(k) if isinstance(k, int) else _c(k))
    return index_year(shifted), index_month(shifted)


def cyclic_month(month: ColumnLike) -> tuple[Column, Column]:
    angle = _c(month) * F.lit(2.0 * math.pi / 12.0)
    return F.sin(angle), F.cos(angle)


def circular_angle(degrees: ColumnLike) -> tuple[Column, Column]:
    return F.sin(F.radians(_c(degrees))), F.cos(F.radians(_c(degrees)))


def month_label(month: ColumnLike) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), _c(month).cast("int"))


def assign_split(year: ColumnLike, train_end: int = 2018, validation_end: int = 2021) -> Column:
    y = _c(year)
    return F.when(y <= train_end, "train").when(y <= validation_end, "val").otherwise("test")


# --- identifiers and text -------------------------------------------------------------------

def normalise_id(value: ColumnLike, width: int = 3) -> Column:
    """Drop a trailing '.0' and left-pad with zeros; longer ids stay whole."""
    text = F.regexp_replace(F.trim(_c(value).cast("string")), r"\.0$", "")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def normalise_fold_label(value: ColumnLike) -> Column:
    """'fold_3', 'fold-3' and '3' become 3; anything else is null."""
    digits = F.regexp_extract(F.lower(F.trim(_c(value).cast("string"))), r"^(?:fold[_ -]?)?(\d+)$", 1)
    return F.when(digits != "", digits).cast("int")


def composite_key(*parts: ColumnLike) -> Column:
    """Readable key for output only; joins use the columns themselves."""
    return F.concat_ws("|", *[_c(p).cast("string") for p in parts])


def join_sorted(values: ColumnLike, separator: str = ";") -> Column:
    """Aggregate: distinct values, sorted, as one string."""
    return F.array_join(F.array_sort(F.collect_set(_c(values))), separator)


def classify_message(text: ColumnLike) -> Column:
    """Failure category of a fit message; an empty message means no failure."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    label = F.when(t == "", "NONE")
    for name, pattern in FAILURE_PATTERNS:
        label = label.when(t.rlike(pattern), name)
    return label.otherwise("FIT_ERROR")


# --- missing values and flags ---------------------------------------------------------------

def finite(value: ColumnLike) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    v = _c(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_null(value: ColumnLike) -> Column:
    v = _c(value).cast("double")
    return F.when(finite(v), v)


def flag_true(value: ColumnLike) -> Column:
    """Null-safe truth of a 0/1 or boolean flag."""
    return F.coalesce(_c(value).cast("int") == 1, F.lit(False))


def null_safe_equal(left: ColumnLike, right: ColumnLike, tol: float = 1e-12) -> Column:
    a, b = _c(left), _c(right)
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tol, F.lit(False))


# --- numbers --------------------------------------------------------------------------------

def unit_scale(value: ColumnLike, scale: float = 1.0, offset: float = 0.0) -> Column:
    return _c(value) * F.lit(float(scale)) + F.lit(float(offset))


def vapour_pressure_deficit(temperature: ColumnLike, dewpoint: ColumnLike) -> Column:
    """Saturation minus actual vapour pressure (kPa, inputs in degrees C), floored at zero."""
    def saturation(t: Column) -> Column:
        return F.lit(0.611) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))

    return F.greatest(saturation(_c(temperature)) - saturation(_c(dewpoint)), F.lit(0.0))


def safe_divide(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Null instead of an ANSI error when the denominator is zero."""
    d = _c(denominator)
    return _c(numerator) / F.when(d != 0, d)


def correlation(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: Pearson r over complete pairs; null without variance, where the built-in raises under ANSI.

    A constant column has equal ends, while its merged variance may be a rounding error above zero.
    """
    a, b = F.when(_c(y).isNotNull(), _c(x)), F.when(_c(x).isNotNull(), _c(y))
    product = F.var_pop(a) * F.var_pop(b)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.covar_pop(a, b) / F.sqrt(F.when(varied & (product > 0), product))


def residual(prediction: ColumnLike, truth: ColumnLike) -> Column:
    return _c(prediction) - _c(truth)


def sign_tol(value: ColumnLike, tol: float = 1e-12) -> Column:
    v = _c(value)
    return F.when(v > tol, 1).when(v < -tol, -1).when(v.isNotNull(), 0).cast("int")


def direction_text(value: ColumnLike, tol: float = 1e-12) -> Column:
    # fixed values: the three texts
    s = sign_tol(value, tol)
    return (
        F.when(s == 1, "positive mean attribution")
        .when(s == -1, "negative mean attribution")
        .when(s == 0, "near-zero mean attribution")
    )


def classify(value: ColumnLike, cuts: Sequence[tuple[str, float, str]], otherwise: str) -> Column:
    """First matching cut wins; a cut is (operator, limit, label) with operator in < <= > >=."""
    v = _c(value)
    tests = {"<": v.__lt__, "<=": v.__le__, ">": v.__gt__, ">=": v.__ge__}
    label = F.when(v.isNull(), F.lit(None).cast("string"))
    for op, limit, name in cuts:
        label = label.when(tests[op](F.lit(limit)), name)
    return label.otherwise(otherwise)


def rank_quartile_bin(rank: ColumnLike) -> Column:
    """Right-closed quartile bins of a rank in [0, 1]."""
    # fixed values: the three cuts
    cuts = [("<=", 0.25, RANK_QUARTILE_LABELS[0]), ("<=", 0.50, RANK_QUARTILE_LABELS[1]), ("<=", 0.75, RANK_QUARTILE_LABELS[2])]
    return classify(rank, cuts, RANK_QUARTILE_LABELS[3])


def shift_class(median: ColumnLike, distance: ColumnLike, outside: ColumnLike) -> Column:
    """limited / moderate / pronounced, from the three shift measures together."""
    def within(m: float, d: float, o: float) -> Column:
        return (F.abs(_c(median)) < m) & (_c(distance) < d) & (_c(outside) < o)

    # fixed values: limits and class names
    return F.when(within(0.25, 0.25, 0.05), "limited").when(within(0.5, 0.5, 0.1), "moderate").otherwise("pronounced")


# The outcomes of a sensitivity analysis, by family.
STRICT_OUTCOMES = ["SUPPORT_FAIL", "DIAGNOSTIC_STOP", "DIRECTION_FAIL", "CI_CROSSES_ZERO", "ROBUSTNESS_PASS"]
COVERAGE_OUTCOMES = [
    "COVERAGE_LIMITED_FIXED_CONTRAST_UNSUPPORTED", "DIAGNOSTIC_STOP", "SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED",
    "DIRECTION_AND_INTERVAL_CONSISTENT", "DIRECTIONALLY_CONSISTENT_COVERAGE_LIMITED",
]


def decision_label(
    analysis: ColumnLike, contrast: ColumnLike, ci_upper: ColumnLike, support: ColumnLike, stop: ColumnLike,
    coverage_limited: Sequence[str] = ("QA2",),
) -> Column:
    """Outcome of a sensitivity analysis from direction, interval, support and diagnostics.

    Support that is unknown does not count as support, a stop that is unknown is no stop, and an estimate or bound that
    is not finite counts as missing.
    """
    a, est, hi = _c(analysis), finite_or_null(contrast), finite_or_null(ci_upper)
    supported, stopped = flag_true(support), flag_true(stop)
    below = F.coalesce(hi < 0, F.lit(False))
    unsupported, halted, wrong, crossing, passed = STRICT_OUTCOMES
    strict = F.when(~supported, unsupported).when(stopped, halted).when(est.isNull() | (est >= 0), wrong).when(~below, crossing).otherwise(passed)
    uncovered, halted, reversed_, consistent, limited = COVERAGE_OUTCOMES
    covered = F.when(~supported, uncovered).when(est.isNull(), halted).when(est > 0, reversed_).when(below, consistent).otherwise(limited)
    return F.concat_ws("_", a, F.when(a.isin(list(coverage_limited)), covered).otherwise(strict))


# The outcomes of other domains and of added covariates.
DOMAIN_UNSUPPORTED, DOMAIN_STOP = "DOMAIN_SENSITIVITY_FIXED_CONTRAST_UNSUPPORTED", "DOMAIN_SENSITIVITY_DIAGNOSTIC_STOP"
REVERSED, IMPRECISE = "SIGN_REVERSAL_ANALYSIS_CHECK_REQUIRED", "DIRECTIONALLY_CONSISTENT_BUT_IMPRECISE"
DOMAIN_PASSED = {"FULL_YEAR": "DIRECTION_AND_INTERVAL_CONSISTENT", "APR_SEP": "ROBUSTNESS_PASS"}
ADJUSTED_PASSED = {"MODEL2": "ADJUSTMENT_ROBUSTNESS_PASS", "MODEL3": "HIGH_ADJUSTMENT_DIRECTION_AND_INTERVAL_CONSISTENT"}
HALTED, NOT_SUPPORTED, ZERO = "DIAGNOSTIC_STOP", "FIXED_CONTRAST_UNSUPPORTED", "ZERO_CONTRAST_ANALYSIS_CHECK_REQUIRED"


def _by_name(name: Column, texts: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), name)


def domain_label(analysis: ColumnLike, contrast: ColumnLike, ci_upper: ColumnLike, support: ColumnLike, stop: ColumnLike) -> Column:
    """Outcome of an analysis on another domain: FULL_YEAR, anything else is the season. Missing values as in `decision_label`."""
    name = F.when(_c(analysis) == "FULL_YEAR", "FULL_YEAR").otherwise("APR_SEP")
    est, below = finite_or_null(contrast), F.coalesce(finite_or_null(ci_upper) < 0, F.lit(False))
    found = F.when(est > 0, F.lit(REVERSED)).when(below, _by_name(name, DOMAIN_PASSED)).otherwise(IMPRECISE)
    return F.when(~flag_true(support), DOMAIN_UNSUPPORTED).when(flag_true(stop) | est.isNull(), DOMAIN_STOP).otherwise(F.concat_ws("_", name, found))


def adjustment_label(model: ColumnLike, contrast: ColumnLike, ci_upper: ColumnLike, support: ColumnLike, stop: ColumnLike) -> Column:
    """Outcome of a model with added covariates, MODEL2 or MODEL3 in any case; a stop goes before missing support.

    A missing estimate is a stop; a missing bound is not below zero.
    """
    name = F.upper(_c(model))
    est, below = finite_or_null(contrast), F.coalesce(finite_or_null(ci_upper) < 0, F.lit(False))
    found = (
        F.when(flag_true(stop) | est.isNull(), F.lit(HALTED)).when(~flag_true(support), NOT_SUPPORTED).when(est > 0, REVERSED)
        .when(est == 0, ZERO).when(below, _by_name(F.when(name == "MODEL2", name).otherwise("MODEL3"), ADJUSTED_PASSED)).otherwise(IMPRECISE)
    )
    return F.concat_ws("_", name, found)


# --- columns of a frame ---------------------------------------------------------------------

def one_hot(df: DataFrame, code: str, levels: Mapping[object, str]) -> DataFrame:
    """One 0/1 column per level; a code outside `levels` gives zeros everywhere."""
    hits = {name: F.coalesce((F.col(code) == F.lit(k)).cast("double"), F.lit(0.0)) for k, name in levels.items()}
    return df.withColumns(hits)


def with_levels(df: DataFrame, column: str, levels: Sequence, fields: Sequence[str] | None = None) -> DataFrame:
    """Repeat every row once per literal level: a generator, not a join.

    With `fields`, a level is a tuple and becomes that many columns.
    """
    if fields is None:
        return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in levels])))
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, level)]) for level in levels]
    kept = [c for c in df.columns if c not in fields]
    return df.withColumn(column, F.explode(F.array(*structs))).select(*kept, *[F.col(f"{column}.{n}").alias(n) for n in fields])


def to_long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide measures to (name, value) rows with one generator."""
    cells = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))
