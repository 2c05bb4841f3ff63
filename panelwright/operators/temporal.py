"""Per-entity time operators.

A panel has one row per (entity, period), so a window partition never holds more rows than the
calendar has periods, however large the tables behind the panel are. All operators here partition
by the same entity keys, so chained calls share one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import correlation
from panelwright.operators.ordering import dense_index


def _ordered(keys: Sequence[str], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def fill_calendar(
    df: DataFrame, keys: Sequence[str], time: str, start: Column | None = None, end: Column | None = None,
    constant: Sequence[str] = (),
) -> DataFrame:
    """Insert the missing periods of every entity, measures null, `constant` columns kept.

    Each row generates the periods since its predecessor, so no spine join is needed.
    """
    w = _ordered(keys, time)
    first = F.col(time) if start is None else start
    last = F.col(time) if end is None else F.greatest(end, F.col(time))
    lo = F.coalesce(F.lag(time).over(w) + 1, first)
    hi = F.when(F.lead(time).over(w).isNull(), last).otherwise(F.col(time))
    spread = df.withColumn("_lo", F.least(lo, F.col(time))).withColumn("_hi", hi)
    spread = spread.withColumn("_t", F.explode(F.sequence("_lo", "_hi")))
    measured = [c for c in df.columns if c not in (*keys, time, *constant)]
    return spread.select(
        *keys, *constant, F.col("_t").alias(time), *[F.when(F.col("_t") == F.col(time), F.col(c)).alias(c) for c in measured]
    )


def bounded_ffill(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], limit: int = 2) -> DataFrame:
    """Carry the last value forward over at most `limit` consecutive missing rows."""
    w = _ordered(keys, time).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def positional_lag(df: DataFrame, keys: Sequence[str], time: str, cols: Mapping[str, str], k: int = 1) -> DataFrame:
    """Value of the k-th previous row; `cols` maps source to new column."""
    w = _ordered(keys, time)
    return df.withColumns({new: F.lag(old, k).over(w) for old, new in cols.items()})


def antecedent(df: DataFrame, keys: Sequence[str], time: str, value: str, out: str, n: int = 3, how: str = "sum") -> DataFrame:
    """Sum or mean of the n previous rows; null unless all n are present."""
    parts = [F.lag(value, k).over(_ordered(keys, time)) for k in range(1, n + 1)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn(out, total if how == "sum" else total / F.lit(float(n)))


def history_windows(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], target: str, windows: Sequence[int]
) -> DataFrame:
    """Rows with a finite target and a complete, contiguous history of max(windows) periods.

    Adds one array of structs `history_<W>` (oldest first) per window. The target row itself is
    never part of its history.
    """
    span = max(windows)
    w = _ordered(keys, time).rowsBetween(-span, -1)
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    flagged = df.withColumn("_ok", complete)
    built = (
        flagged.withColumn("_n", F.count(F.when(F.col("_ok"), 1)).over(w))
        .withColumn("_from", F.min(time).over(w))
        .withColumn("_h", F.collect_list(F.struct(time, *values)).over(w))
        .where((F.col("_n") == span) & (F.col(time) - F.col("_from") == span) & F.col(target).isNotNull())
    )
    arrays = {f"history_{k}": F.slice("_h", span - k + 1, k) for k in windows}
    return built.withColumns(arrays).drop("_ok", "_n", "_from", "_h")


def history_samples(
    df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], target: str, span: int
) -> DataFrame:
    """The target rows `history_windows` keeps, without building the arrays."""
    w = _ordered(keys, time).rowsBetween(-span, -1)
    complete = F.lit(True)
    for v in values:
        complete = complete & F.col(v).isNotNull()
    return (
        df.withColumn("_n", F.count(F.when(complete, 1)).over(w))
        .withColumn("_from", F.min(time).over(w))
        .where((F.col("_n") == span) & (F.col(time) - F.col("_from") == span) & F.col(target).isNotNull())
        .drop("_n", "_from")
    )


def lagged_long(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], window: int) -> DataFrame:
    """History in long form: (keys, target time, lag, feature, value).

    Every cell pushes itself to the targets it precedes: a generator, no window and no join.
    """
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    return (
        df.select(*keys, F.col(time).alias("_t"), F.array(*cells).alias("_cells"))
        .withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(window))))
        .select(*keys, (F.col("_t") + F.col("lag")).alias(time), "lag", F.inline("_cells"))
    )


def assign_sample_id(df: DataFrame, keys: Sequence[str], time: str, warmup: int, out: str = "sample_id") -> DataFrame:
    """Dense ids in (entity, time) order after dropping each entity's first `warmup` rows."""
    kept = df.withColumn("_rn", F.row_number().over(_ordered(keys, time))).where(F.col("_rn") > warmup).drop("_rn")
    return dense_index(kept, [*keys, time], out)


def exclusion_keys(bad: DataFrame, keys: Sequence[str], time: str, window: int) -> DataFrame:
    """Distinct target keys whose history of `window` periods contains an invalid input."""
    pushed = bad.select(*keys, F.explode(F.sequence(F.col(time) + 1, F.col(time) + window)).alias(time))
    return pushed.distinct()


def affected_by_invalid(
    df: DataFrame, bad: DataFrame, keys: Sequence[str], time: str, window: int, out: str = "affected"
) -> DataFrame:
    """Flag targets t with an invalid input in [t-window, t-1]; the range join becomes an equi-join."""
    hits = exclusion_keys(bad, keys, time, window).withColumn(out, F.lit(True))
    return df.join(hits, [*keys, time], "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def filter_domain(df: DataFrame, bad: DataFrame, keys: Sequence[str], time: str, window: int | None) -> DataFrame:
    """The clean domain for `window`, or the full domain when it is None."""
    if window is None:
        return df
    return df.join(exclusion_keys(bad, keys, time, window), [*keys, time], "left_anti")


def common_domain(df: DataFrame, bad: DataFrame, keys: Sequence[str], time: str, windows: Sequence[int]) -> DataFrame:
    """Rows clean for every window; windows are nested, so the longest decides."""
    return filter_domain(df, bad, keys, time, max(windows))


# --- sections, gaps and pairs ---------------------------------------------------------------

def section_starts(df: DataFrame, keys: Sequence[str], time: str, out: str = "section") -> DataFrame:
    """`section_start` and a section number per entity; a gap of more than one period opens a section."""
    w = _ordered(keys, time)
    previous = F.lag(time).over(w)
    started = df.withColumn("section_start", previous.isNull() | (F.col(time) - previous > 1))
    running = F.sum(F.col("section_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return started.withColumn(out, running.cast("int"))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as a scalar subquery; no join."""
    cols = one_row.columns
    return df.withColumn("_row", one_row.select(F.struct(*cols)).scalar()).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in cols])


def _spread(value: str, weight: str, prefix: str) -> list[Column]:
    """min / median / mean / max of a small-integer column given its frequencies."""
    return [
        F.min(value).alias(f"{prefix}_min"),
        F.percentile(value, F.lit(0.5), F.col(weight)).alias(f"{prefix}_median"),
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(f"{prefix}_mean"),
        F.max(value).alias(f"{prefix}_max"),
    ]


def section_summary(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row: records, entities, sections, section lengths, gaps.

    Lengths are bounded by the calendar, so everything follows from their frequency table.
    """
    sections = section_starts(df, keys, time).groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("length"))
    lengths = sections.groupBy("length").agg(
        F.count(F.lit(1)).alias("_f"), F.count(F.when(F.col("section") == 1, 1)).alias("_e")
    )
    return lengths.agg(
        F.sum(F.col("length") * F.col("_f")).alias("n_records"), F.sum("_e").alias("n_entities"),
        F.sum("_f").alias("n_sections"), *_spread("length", "_f", "section_length"),
        (F.sum("_f") - F.sum("_e")).alias("gap_count"),
    )


def gap_inventory(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Each gap: previous and current period, distance, number of missing periods."""
    w = _ordered(keys, time)
    return (
        df.select(*keys, F.lag(time).over(w).alias("previous_period"), F.col(time).alias("current_period"))
        .withColumn("delta", F.col("current_period") - F.col("previous_period"))
        .where(F.col("delta") > 1)
        .withColumn("missing_periods", F.col("delta") - 1)
    )


def gap_distribution(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    return (
        gap_inventory(df, keys, time).groupBy("delta").agg(F.count(F.lit(1)).alias("n_gaps"))
        .withColumn("missing_periods", F.col("delta") - 1)
    )


def consecutive_pairs(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """(value at t-1, value at t) where both exist and t-1 is the previous row."""
    w = _ordered(keys, time)
    return (
        df.select(
            *keys, F.lag(time).over(w).alias("period_before"), F.col(time).alias("period"),
            F.lag(value).over(w).alias("value_before"), F.col(value).alias("value"),
        )
        .where((F.col("period") - F.col("period_before") == 1) & F.col("value_before").isNotNull() & F.col("value").isNotNull())
    )


def lag1_autocorrelation(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Lag-1 correlation of consecutive pairs, with the distribution of pair counts per entity."""
    pairs = consecutive_pairs(df, keys, time, value)
    overall = pairs.agg(correlation("value_before", "value").alias("rho"), F.count(F.lit(1)).alias("n_pairs"))
    per = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs")).groupBy("pairs").agg(F.count(F.lit(1)).alias("_f"))
    counts = per.agg(F.sum("_f").alias("n_entities"), *_spread("pairs", "_f", "pairs_per_entity"))
    return attach_row(overall, counts)


def sequence_acf(df: DataFrame, keys: Sequence[str], time: str, value: str, max_lag: int = 12) -> DataFrame:
    """Correlation at lags 1..max_lag over unbroken runs only: row offset must equal period offset."""
    w = _ordered(keys, time)
    cells = [
        F.struct(
            F.lit(k).alias("lag"), (F.col(time) - F.lag(time, k).over(w)).alias("delta"), F.lag(value, k).over(w).alias("before")
        )
        for k in range(1, max_lag + 1)
    ]
    valid = (F.col("delta") == F.col("lag")) & F.col("before").isNotNull() & F.col("_now").isNotNull()
    return (
        df.select(F.col(value).alias("_now"), F.array(*cells).alias("_cells"))
        .select("_now", F.inline("_cells"))
        .groupBy("lag")
        .agg(
            correlation(F.when(valid, F.col("before")), F.when(valid, F.col("_now"))).alias("correlation"), F.count(F.when(valid, 1)).alias("n_pairs")
        )
    )


# --- calendars ------------------------------------------------------------------------------

def allocate_days_to_months(
    df: DataFrame, keys: Sequence[str], start: str, value: str, out: str, span: int = 8, cap: str | None = None
) -> DataFrame:
    """Split each composite over the calendar months it covers, in proportion to days, and sum.

    A composite ends at the next distinct start of any entity when that is 1..span days away,
    else after `span` days; `cap` limits the end of the very last one.
    """
    # one row per distinct start date: bounded by the calendar, so one ordered window is enough
    starts = df.select(start).where(F.col(start).isNotNull()).distinct()
    following = F.lead(start).over(Window.partitionBy(F.lit(0)).orderBy(start))
    plus = F.date_add(start, span)
    last = plus if cap is None else F.least(plus, F.lit(cap).cast("date"))
    ends = starts.withColumn("_next", following).withColumn(
        "_end",
        F.when(F.col("_next").isNull(), last).when(F.datediff("_next", start) <= span, F.col("_next")).otherwise(plus),
    )
    ends = ends.withColumn("_end", F.when(F.datediff("_end", start).between(1, span), F.col("_end")).otherwise(plus))
    pieces = (
        df.where(F.col(value).isNotNull()).join(F.broadcast(ends.drop("_next")), start)  # one row per start date
        .withColumn("_m", F.explode(F.expr(f"sequence(trunc({start}, 'MM'), trunc(date_sub(_end, 1), 'MM'), interval 1 month)")))
        .withColumn("_days", F.datediff(F.least("_end", F.add_months("_m", 1)), F.greatest(start, "_m")))
        .withColumn("_part", F.col(value) * F.col("_days") / F.datediff("_end", start))
    )
    return pieces.groupBy(*keys, F.year("_m").alias("year"), F.month("_m").alias("month")).agg(F.sum("_part").alias(out))


def complete_years(df: DataFrame, keys: Sequence[str], year: str = "year", month: str = "month") -> DataFrame:
    """Entity-years with each of the twelve months exactly once."""
    return (
        df.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("n_months"), F.count_distinct(month).alias("_d"))
        .where((F.col("n_months") == 12) & (F.col("_d") == 12)).drop("_d")
    )


def annual_sums(df: DataFrame, keys: Sequence[str], truth: str, prediction: str, year: str = "year", month: str = "month") -> DataFrame:
    """Sums over complete entity-years with the residual; one aggregation decides and sums."""
    return (
        df.groupBy(*keys, year)
        .agg(
            F.count(F.col(truth) + F.col(prediction)).alias("_n"), F.count(F.lit(1)).alias("_rows"), F.count_distinct(month).alias("_d"),
            F.sum(truth).alias(truth), F.sum(prediction).alias(prediction),
        )
        .where((F.col("_n") == 12) & (F.col("_rows") == 12) & (F.col("_d") == 12))
        .select(*keys, year, truth, prediction, (F.col(prediction) - F.col(truth)).alias("residual"))
    )


def annual_means(annual: DataFrame, truth: str, prediction: str, year: str = "year", by: Sequence[str] = ()) -> DataFrame:
    """Mean over entities per year and level of `by`."""
    return annual.groupBy(*by, year).agg(
        F.count(F.lit(1)).alias("n_entities"), *[F.avg(c).alias(f"{c}_mean") for c in (truth, prediction, "residual")]
    )


def leave_one_year_out(df: DataFrame, keys: Sequence[str], time: str, years: Sequence[int], year: str = "year") -> DataFrame:
    """One copy of the data per omitted year, sections rebuilt across the hole."""
    copies = df.withColumn("omitted_year", F.explode(F.array(*[F.lit(y) for y in years]))).where(F.col(year) != F.col("omitted_year"))
    return section_starts(copies, ["omitted_year", *keys], time)


def ordered_decile(df: DataFrame, value: str, tie_keys: Sequence[str], out: str = "decile", groups: int = 10) -> DataFrame:
    """floor(position * groups / n) + 1 in (value, keys) order, over the whole table."""
    placed = dense_index(df, [value, *tie_keys], "_i")
    n = df.select(F.count(F.lit(1))).scalar()
    return placed.withColumn(out, (F.floor(F.col("_i") * groups / n) + 1).cast("int")).drop("_i")


def explode_history(df: DataFrame, history: str, window: int, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Arrays of `history_windows` to (keep, lag, feature, value) rows; the newest entry is lag 1."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_s.{f}").alias("value")) for f in features])
    steps = df.select(*keep, F.posexplode(history).alias("_p", "_s"))
    return steps.select(*keep, (F.lit(window) - F.col("_p")).alias("lag"), F.inline(cells))
