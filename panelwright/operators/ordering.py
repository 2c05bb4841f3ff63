"""Global order statistics without a single-task window.

`running_sums` range-partitions by (group, order) so that a hot group is spread over many tasks,
writes that layout with its partition numbers to the checkpoint folder once (so both passes see the
same partitions, also after an executor is lost), and adds per-partition offsets to local running sums. The offsets
hold one row per (group, partition). `bounded=True` is for groups whose size is fixed by a
catalogue or a calendar; it uses a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import broadcast_if_small, cut_lineage


def running_sums(
    df: DataFrame, values: Mapping[str, Column], order_by: Sequence[str], by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """Inclusive running sums (output name -> value) in `order_by` order within `by`; the order must be unique per group."""
    if bounded:
        w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(v).over(w) for k, v in values.items()})
    names = list(values)
    laid = df.withColumns({f"_v_{k}": v for k, v in values.items()}).repartitionByRange(*by, *order_by)
    laid = cut_lineage(laid.withColumn("_pid", F.spark_partition_id()))
    totals = laid.groupBy(*by, "_pid").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in names])
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_pid", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names])
    local = Window.partitionBy("_pid", *by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(local) for k in names})
        .join(offsets, [*by, "_pid"])
        .withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in names})
        .drop("_pid", *[f"{x}{k}" for x in ("_v_", "_l_", "_o_") for k in names])
    )


def running_sum(
    df: DataFrame, value: Column | int, order_by: Sequence[str], out: str, by: Sequence[str] = (), bounded: bool = False
) -> DataFrame:
    """One running sum; see `running_sums`."""
    return running_sums(df, {out: F.lit(value) if isinstance(value, int) else value}, order_by, by, bounded)


def dense_index(df: DataFrame, order_by: Sequence[str], out: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """0-based dense position in `order_by` order within `by`."""
    return running_sum(df, 1, order_by, out, by, bounded).withColumn(out, (F.col(out) - 1).cast("long"))


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None, bounded: bool = False
) -> DataFrame:
    """Per distinct value: n (its weight), n_before (weight of smaller values). Nulls are left out."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running_sum(counts, F.col("n"), [value], "n_upto", by, bounded).select(
        *by, value, "n", (F.col("n_upto") - F.col("n")).alias("n_before")
    )


def average_rank(
    df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = (), descending: bool = False,
    ties: str = "average", bounded: bool = False,
) -> DataFrame:
    """1-based rank with average (or minimum) ties within `by`."""
    if bounded:
        order = F.col(value).desc() if descending else F.col(value).asc()
        w = Window.partitionBy(*by).orderBy(order)
        first = F.rank().over(w).cast("double")
        if ties == "min":
            return df.withColumn(out, first)
        same = F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1
        return df.withColumn(out, first + same / F.lit(2.0))
    signed = "_key"
    keyed = df.withColumn(signed, -F.col(value) if descending else F.col(value))
    counts = value_counts(keyed, signed, by)
    rank = F.col("n_before") + (F.lit(1.0) if ties == "min" else (F.col("n") + 1) / F.lit(2.0))
    # few distinct values may each hold many rows: then the counted lookup is broadcast and no key is hot;
    # otherwise values are near unique and adaptive execution splits a partition that is not
    ranks = broadcast_if_small(counts.select(*by, signed, rank.cast("double").alias(out)))
    return keyed.join(ranks, [*by, signed], "left").drop(signed)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on `keys` where null meets null; the keys appear once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def _coarse_digit(x: Column) -> Column:
    """Monotone digit of a double: its sign and 1/23 of its natural logarithm; zero, infinities and NaN have digits of their own."""
    size = F.least(F.floor((F.log(F.abs(x)) + 746) * 23), F.lit(40_000))
    return F.when(F.isnan(x), 50_000).when(x > 0, size + 1).when(x < 0, -size - 1).otherwise(0).cast("int")


def _spread(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """`_before` (rows in smaller digits) and `_all` (rows of the cell); a cell has at most some 80,000 digits, so a plain window is bounded."""
    cell = Window.partitionBy(*(by or [F.lit(0)]))
    upto = cell.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumns({"_before": F.sum("_c").over(upto) - F.col("_c"), "_all": F.sum("_c").over(cell)})


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), inverse_cdf: bool = False, digits: int = 65_536,
) -> DataFrame:
    """Exact quantiles per group by radix passes, without sorting or shuffling the column; the same road for every size.

    A pass counts rows per (cell, digit) with partial aggregation and keeps the smallest and largest value of each digit.
    The digit that holds a wanted position is the next pass's cell: exactly the values between that smallest and that
    largest one. The first pass takes sign and magnitude as its digit and has a whole group as its cell; later ones cut a
    cell into `digits` equal widths. A cell's two ends never share a digit, so every pass narrows it; one of a single value
    is the answer. Doubles in a first cell differ in some 49 bits, so four or five passes end it, most data need fewer.
    Every digit is a monotone function of the value, so ranks add up exactly and nothing can be missed.

    Nulls in the column are left out, a null in `by` is a group, NaN is the largest value, -0.0 equals 0.0; a group without
    values has no row, and without `by` one row of nulls. Linear interpolation by default; `inverse_cdf` gives the smallest value whose ECDF reaches p. The column and its
    keys are written once to the checkpoint folder, so all passes see the same bits whatever the input's sums were added
    up from; between passes a few rows per group are.
    """
    by = list(by)
    base = cut_lineage(df.where(F.col(value).isNotNull()).select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("_x")))
    ends = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    wanted = []
    for i, p in enumerate(probs.values()):
        if inverse_cdf:
            wanted.append((2 * i, F.greatest(F.ceil(F.col("_all") * F.lit(p) - 1e-9) - 1, F.lit(0))))
        else:
            low = F.floor((F.col("_all") - 1) * F.lit(p))
            wanted += [(2 * i, low), (2 * i + 1, F.least(low + 1, F.col("_all") - 1))]
    targets = F.array(*[F.struct(F.lit(i).alias("t"), place.cast("long").alias("at")) for i, place in wanted])

    def picked(spread: DataFrame, n: Column) -> DataFrame:
        """One row per target: its digit's ends, and its position inside the digit."""
        here = F.filter("_targets", lambda t: (F.col("_before") <= t["at"]) & (t["at"] < F.col("_before") + F.col("_c")))
        rows = spread.select(*by, "_lo", "_hi", "_before", n.alias("_n"), F.explode(here).alias("_t"))
        return cut_lineage(rows.select(*by, "_n", "_lo", "_hi", F.col("_t.t").alias("_t"), (F.col("_t.at") - F.col("_before")).alias("_at")))

    first = base.groupBy(*by, _coarse_digit(F.col("_x")).alias("_digit")).agg(*ends)
    picks = picked(_spread(first, by).withColumn("_targets", targets), F.col("_all"))
    answers = []
    while True:
        answers.append(picks.where("_lo = _hi").select(*by, "_n", "_t", F.col("_lo").alias("_v")))
        unsettled = picks.where("_lo < _hi")
        most = 200_000  # rows of a broadcast; more cells are left to Spark's joins
        count = unsettled.limit(most + 1).count()
        if not count:
            break
        sent = F.broadcast if count <= most else (lambda table: table)
        cells = unsettled.groupBy(*by, "_n", "_lo", "_hi").agg(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_at").alias("at"))).alias("_targets"))
        cells = cells.withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
        per_group = cells.groupBy(*by).agg(F.collect_list(F.struct("_from", "_to")).alias("_cells"))
        if by:
            rows = _null_safe(base, sent(per_group), by)
        else:
            rows = base.withColumn("_cells", per_group.select("_cells").scalar())
        inside = F.filter("_cells", lambda c: F.col("_x").between(c["_from"], c["_to"]))
        rows = rows.select(*by, "_x", F.get(inside, F.lit(0)).alias("_cell")).where("_cell is not null")
        width = F.col("_cell._to") - F.col("_cell._from")
        digit = F.floor((F.col("_x") - F.col("_cell._from")) / width * digits).cast("int")
        cell = [*by, "_from", "_to"]
        counted = rows.groupBy(*by, F.col("_cell._from").alias("_from"), F.col("_cell._to").alias("_to"), digit.alias("_digit")).agg(*ends)
        picks = picked(_null_safe(_spread(counted, cell), sent(cells), cell), F.col("_n"))
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)

    def at(i: int) -> Column:
        return F.max(F.when(F.col("_t") == i, F.col("_v")))

    quantiles = []
    for i, (k, p) in enumerate(probs.items()):
        if inverse_cdf:
            quantiles.append(at(2 * i).alias(k))
        else:
            place = (F.max("_n") - 1) * F.lit(p)
            quantiles.append((at(2 * i) + F.when(at(2 * i + 1) == at(2 * i), 0.0).otherwise(at(2 * i + 1) - at(2 * i)) * (place - F.floor(place))).alias(k))
    return found.groupBy(*by).agg(F.max("_n").alias("n"), *quantiles)
