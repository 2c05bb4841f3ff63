"""Distribution shift, rank agreement, overlap and composition comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import classify, correlation, safe_divide, shift_class
from panelwright.operators.inversions import count_inversions
from panelwright.operators.ordering import average_rank, dense_index, exact_quantiles, running_sum, running_sums, value_counts
from panelwright.operators.temporal import attach_row
from panelwright.session import broadcast_if_small, cut_lineage

# Limits and names of the agreement classes.
STRENGTH_RHO = [(">=", 0.80, "STRONG"), (">=", 0.60, "MODERATE")]
STRENGTH_AGREEMENT = [(">=", 0.70, "STRONG"), (">=", 0.50, "MODERATE")]


# --- distributions --------------------------------------------------------------------------

def paired_ecdf(a: DataFrame, b: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per group and distinct value: counts in both samples, running counts, sizes.

    Both sides reduce to counts per distinct value before one distributed ordering; every
    distribution measure below is an aggregate of this table.
    """
    tagged = a.select(*by, F.col(value).alias("_x"), F.lit(1).alias("_a")).unionByName(b.select(*by, F.col(value).alias("_x"), F.lit(0).alias("_a")))
    counts = tagged.where(F.col("_x").isNotNull()).groupBy(*by, "_x").agg(F.sum("_a").alias("_na"), F.sum(1 - F.col("_a")).alias("_nb"))
    cum = running_sums(counts, {"_ua": F.col("_na"), "_ub": F.col("_nb")}, ["_x"], by)
    return attach_group(cum, cum.groupBy(*by).agg(F.max("_ua").alias("n_a"), F.max("_ub").alias("n_b"), F.avg("_x").alias("_mid")), by)


def attach_group(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Columns of a one-row-per-group table on every row; without groups the table has one row."""
    return df.join(broadcast_if_small(per_group), list(by)) if by else attach_row(df, per_group)


def _area() -> Column:
    """Area between the ECDFs. Summing by parts it is the sum of x * (|D before x| - |D after x|), so a
    row needs only its own running difference D."""
    after = F.col("_ua") / F.col("n_a") - F.col("_ub") / F.col("n_b")
    before = (F.col("_ua") - F.col("_na")) / F.col("n_a") - (F.col("_ub") - F.col("_nb")) / F.col("n_b")
    return F.sum((F.col("_x") - F.col("_mid")) * (F.abs(before) - F.abs(after)))


def wasserstein_1d(a: DataFrame, b: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Wasserstein-1 distance per group; groups missing from one side have none."""
    cum = paired_ecdf(a, b, value, by).where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    return cum.groupBy(*by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), _area().alias("wasserstein"))


def _quantile(p: float, upto: str, own: str, n: str) -> Column:
    """Linear-interpolated quantile of one side as an aggregate over the running counts."""
    pos = (F.col(n) - 1) * F.lit(p)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col(upto) - F.col(own) <= k) & (k < F.col(upto)), F.col("_x")))

    left, right = at(F.floor(pos)), at(F.least(F.floor(pos) + 1, F.col(n) - 1))
    return left + (right - left) * F.max(pos - F.floor(pos))


def shift_summary(train: DataFrame, evaluation: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Median shift and Wasserstein distance in units of the training IQR, share outside P1-P99, class.

    One pass over each side; quantiles, distance and the outside share all come from the running counts.
    """
    cum = cut_lineage(paired_ecdf(train, evaluation, value, by).where((F.col("n_a") > 0) & (F.col("n_b") > 0)))
    probs = {"p01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p99": 0.99}
    ref = cum.groupBy(*by).agg(
        F.max("n_a").alias("training_n"), F.max("n_b").alias("evaluation_n"), _area().alias("wasserstein"),
        *[_quantile(p, "_ua", "_na", "n_a").alias(k) for k, p in probs.items()], _quantile(0.5, "_ub", "_nb", "n_b").alias("eval_median"),
    )
    ref = cut_lineage(ref)  # one row per group, read twice
    tail = (F.col("_x") < F.col("p01")) | (F.col("_x") > F.col("p99"))
    outside = attach_group(cum, ref.select(*by, "p01", "p99"), by).groupBy(*by).agg(
        (F.sum(F.when(tail, F.col("_nb")).otherwise(0)) / F.max("n_b")).alias("outside_share")
    )
    iqr = F.when(F.col("q75") > F.col("q25"), F.col("q75") - F.col("q25"))
    out = (outside.join(ref, list(by)) if by else attach_row(outside, ref)).select(
        *by, "training_n", "evaluation_n", ((F.col("eval_median") - F.col("q50")) / iqr).alias("median_shift"),
        (F.col("wasserstein") / iqr).alias("wasserstein_iqr"), "outside_share",
    )
    return out.withColumn("shift_class", shift_class("median_shift", "wasserstein_iqr", "outside_share"))


# --- rank agreement -------------------------------------------------------------------------

def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], bounded: bool = False, written: bool = False) -> DataFrame:
    """Pearson correlation of average ranks per group. `written` says that `df` is a table already, cheap to read again."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not bounded and not written:
        base = cut_lineage(base.select(*by, x, y))  # read once per ranked column
    ranked = average_rank(average_rank(base, x, "_rx", by, bounded=bounded), y, "_ry", by, bounded=bounded)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("spearman"))


def kendall_tau_b(df: DataFrame, x: str, y: str, by: Sequence[str], keys: Sequence[str], bounded: bool = False, written: bool = False) -> DataFrame:
    """Tau-b per group without forming pairs; `written` as in `spearman`. Rows of null groups are left out.

    Equal (x, y) become one weighted point. Discordant pairs are the points' inversions: each point moves twice, and hot
    values weigh more instead of filling a task (see `inversions`). `bounded` groups, small ones of a catalogue, are
    counted by windows instead.
    """
    if bounded:
        return _bounded_kendall(df, x, y, by, keys, written)
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = cut_lineage(base.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c")))
    pairs = (F.col("_c") * (F.col("_c").cast("decimal(38,0)") - 1) / 2).cast("decimal(38,0)")
    names = ["n", "_n1", "_n2", "_n3", "_d"]

    def part(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select(*by, *[values.get(c, F.lit(None)).cast("decimal(38,0)").alias(c) for c in names])

    long = part(points, n=F.col("_c"), _n3=pairs)
    for name, c in (("_n1", "_x"), ("_n2", "_y")):
        long = long.unionByName(part(points.groupBy(*by, c).agg(F.sum("_c").alias("_c")), **{name: pairs}))
    long = long.unionByName(part(count_inversions(points, by, "_x", "_y", "_c"), _d=F.col("inversions")))
    for c in by:
        long = long.where(F.col(c).isNotNull())
    sums = long.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long" if c == "n" else "double").alias(c) for c in names])
    return sums.select(*by, "n", _tau_b().alias("kendall"))


def _tau_b() -> Column:
    n0 = F.col("n") * (F.col("n") - 1) / 2
    scale = (n0 - F.col("_n1")) * (n0 - F.col("_n2"))
    return (n0 - F.col("_n1") - F.col("_n2") + F.col("_n3") - 2 * F.coalesce("_d", F.lit(0))) / F.sqrt(F.when(scale > 0, scale))


def _bounded_kendall(df: DataFrame, x: str, y: str, by: Sequence[str], keys: Sequence[str], written: bool) -> DataFrame:
    """Tau-b of small groups. Rows are placed in (x, y) order; discordant pairs are the inversions of y's order number,
    found digit by digit with running counts inside the group."""
    bounded = True
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, *keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    base = base if written else cut_lineage(base)  # read by the ordering and by the three tie counts
    ys = value_counts(base, "_y", by, bounded=bounded).select(*by, "_y", F.col("n_before").alias("_r"))
    placed = dense_index(base.join(ys, [*by, "_y"]), ["_x", "_y", *keys], "_i", by, bounded)
    sizes = placed.groupBy(*by).agg(F.max("_i").alias("_top"), F.count(F.lit(1)).alias("n"))
    digits = F.greatest(F.ceil(F.log2(F.col("_top") + 1)), F.lit(1)).cast("int")
    sized = placed.join(sizes, list(by)) if by else placed.withColumn("_top", sizes.select("_top").scalar())
    spread = sized.withColumn("_b", F.explode(F.sequence(F.lit(0), digits - 1)))
    spread = spread.select(*by, "_i", "_b", F.expr("shiftright(_r, _b + 1)").alias("_p"), F.expr("shiftright(_r, _b) & 1").cast("long").alias("_one"))
    counted = running_sum(spread, F.col("_one"), ["_i"], "_ones", [*by, "_b", "_p"], bounded)
    discordant = counted.groupBy(*by).agg(F.sum(F.when(F.col("_one") == 0, F.col("_ones"))).alias("_d"))

    def tied(cols: Sequence[str], out: str) -> DataFrame:
        c = base.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("_c"))
        return c.groupBy(*by).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias(out))

    out = sizes.select(*by, "n")
    for part in (discordant, tied(["_x"], "_n1"), tied(["_y"], "_n2"), tied(["_x", "_y"], "_n3")):
        if by:
            out = out.join(part, list(by))
        else:
            c = [c for c in part.columns][0]
            out = out.withColumn(c, part.select(c).scalar())
    return out.select(*by, "n", _tau_b().alias("kendall"))


def spearman_matrix(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Spearman correlation of every feature pair, from a long table (keys, feature, value).

    Ranks are computed for all features in one ordering; the pairs are aggregates of one wide row.
    """
    ranked = average_rank(df.where(F.col(value).isNotNull()), value, "_rank", [name])
    wide = ranked.groupBy(*keys).pivot(name, list(features)).agg(F.first("_rank"))
    pairs = list(combinations(features, 2))
    cells = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), correlation(a, b).alias("spearman")) for a, b in pairs]
    return wide.agg(F.array(*cells).alias("_c"), F.count(F.lit(1)).alias("n_rows")).select(F.inline("_c"), "n_rows")


def high_correlation_pairs(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    return matrix.withColumn("abs_spearman", F.abs("spearman")).where(F.col("abs_spearman") >= threshold).orderBy(F.col("abs_spearman").desc(), "feature_1", "feature_2")


def run_pairs(df: DataFrame, run: str, pairs: Sequence[tuple[str, str, str]], keys: Sequence[str], values: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Aligned (left, right) values for a fixed catalogue of run pairs (family, left, right).

    One aggregate per key collects the runs (bounded by the catalogue) and a generator lists the
    pairs, so no self-join is needed.
    """
    wanted = sorted({r for _, a, b in pairs for r in (a, b)})
    aggs = [F.max(F.when(F.col(run) == r, F.struct(*values))).alias(f"_r{i}") for i, r in enumerate(wanted)]
    per = df.where(F.col(run).isin(wanted)).groupBy(*keys).agg(*aggs, *[F.max(e).alias(e) for e in extra])
    cells = [
        F.struct(
            F.lit(f).alias("family"), F.lit(a).alias("left_run"), F.lit(b).alias("right_run"),
            F.col(f"_r{wanted.index(a)}").alias("_l"), F.col(f"_r{wanted.index(b)}").alias("_r"),
        )
        for f, a, b in pairs
    ]
    rows = per.select(*keys, *extra, F.inline(F.array(*cells))).where(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    sides = [F.col(f"_l.{v}").alias(f"{v}_left") for v in values] + [F.col(f"_r.{v}").alias(f"{v}_right") for v in values]
    return rows.select("family", "left_run", "right_run", *keys, *extra, *sides)


PAIR = ["family", "left_run", "right_run"]


def run_stability(pairs: DataFrame, entity: str = "entity", top: Sequence[int] = (5, 10)) -> DataFrame:
    """Rank correlations, top-k overlaps and sign agreements of two importance tables."""
    pairs = cut_lineage(pairs)
    counts = pairs.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_entities"),
        *[F.count(F.when((F.col("rank_left") <= k) & (F.col("rank_right") <= k), 1)).alias(f"top{k}_overlap") for k in top],
        F.avg((F.col("sign_left") == F.col("sign_right")).cast("int")).alias("sign_agreement"),
    )
    counts = counts.withColumns({f"top{k}_proportion": F.col(f"top{k}_overlap") / F.least(F.lit(k), F.col("n_entities")) for k in top})
    rho = spearman(pairs, "rank_left", "rank_right", PAIR, bounded=True).drop("n")
    tau = kendall_tau_b(pairs, "rank_left", "rank_right", PAIR, [entity], bounded=True, written=True).drop("n")
    return counts.join(rho, PAIR).join(tau, PAIR)


def lag_profile_stability(pairs: DataFrame, annual: Sequence[int]) -> DataFrame:
    """Per pair and feature: agreement of two lag profiles, peak lags, annual shares."""
    pairs = cut_lineage(pairs)
    by = [*PAIR, "feature"]
    marker = F.col("lag").isin(list(annual))

    def peak(c: str) -> Column:
        return F.max_by("lag", F.struct(F.col(c), -F.col("lag")))

    def share(c: str) -> Column:
        return F.sum(F.when(marker, F.col(c)).otherwise(0.0)) / F.sum(c)

    base = pairs.groupBy(*by).agg(
        peak("mean_abs_left").alias("left_peak"), peak("mean_abs_right").alias("right_peak"),
        share("mean_abs_left").alias("left_annual_share"), share("mean_abs_right").alias("right_annual_share"),
    ).withColumn("peak_match", F.col("left_peak") == F.col("right_peak"))
    rho = spearman(pairs, "mean_abs_left", "mean_abs_right", by, bounded=True).drop("n")
    tau = kendall_tau_b(pairs, "mean_abs_left", "mean_abs_right", by, ["lag"], bounded=True, written=True).drop("n")
    return base.join(rho, by).join(tau, by)


def cohen_kappa(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed agreement and kappa; the marginals come from one table of category counts."""
    pairs = df.groupBy(*by, left, right).agg(F.count(F.lit(1)).alias("_c"))
    cells = F.array(
        F.struct(F.col(left).alias("_cat"), F.col("_c").alias("_l"), F.lit(0).cast("long").alias("_r"), F.when(F.col(left) == F.col(right), F.col("_c")).otherwise(0).alias("_same")),
        F.struct(F.col(right).alias("_cat"), F.lit(0).cast("long").alias("_l"), F.col("_c").alias("_r"), F.lit(0).cast("long").alias("_same")),
    )
    margins = pairs.select(*by, F.inline(cells)).groupBy(*by, "_cat").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), F.sum("_same").alias("_same"))
    n = F.sum("_l")
    out = margins.groupBy(*by).agg(
        n.alias("n"), (F.sum("_same") / n).alias("agreement"), (F.sum(F.col("_l").cast("double") * F.col("_r")) / (n.cast("double") * n)).alias("expected")
    )
    return out.withColumn("kappa", safe_divide(F.col("agreement") - F.col("expected"), F.lit(1.0) - F.col("expected")))


def site_run_comparison(shares: DataFrame, run: str, pairs: Sequence[tuple[str, str, str]], site: str) -> DataFrame:
    """Per run pair and group: rank agreement over matched sites, dominant-group agreement and kappa.

    The site table is not bounded by a catalogue, so ranks use the distributed ordering.
    """
    shares = cut_lineage(shares.select(run, site, "group", "group_abs", "dominant"))  # far smaller than the attributions behind it
    both = cut_lineage(run_pairs(shares, run, pairs, [site, "group"], ["group_abs"]))
    by = [*PAIR, "group"]
    rho = spearman(both, "group_abs_left", "group_abs_right", by, written=True)
    tau = kendall_tau_b(both, "group_abs_left", "group_abs_right", by, [site], written=True).drop("n")
    dominant = shares.where(F.col("dominant") == 1).groupBy(run, site).agg(F.min("group").alias("dominant_group"))
    kappa = cohen_kappa(run_pairs(dominant, run, pairs, [site], ["dominant_group"]), "dominant_group_left", "dominant_group_right", PAIR)
    return (
        rho.withColumnRenamed("n", "matched_sites").join(tau, by).join(kappa.select(*PAIR, "agreement", "kappa"), PAIR)
        .withColumn("spatial_class", classify("spearman", STRENGTH_RHO, "WEAK"))
        .withColumn("dominant_class", classify("agreement", STRENGTH_AGREEMENT, "WEAK"))
    )


def composition_distance(top2: DataFrame, run: str, pairs: Sequence[tuple[str, str, str]], group_class: str) -> tuple[DataFrame, DataFrame]:
    """Per class distances of two share tables, and overall correlations over all class x group cells."""
    both = cut_lineage(run_pairs(top2, run, pairs, [group_class, "group"], ["share", "margin", "top1_group", "top1_share"]))
    d = F.abs(F.col("share_right") - F.col("share_left"))
    classes = both.groupBy(*PAIR, group_class).agg(
        F.avg(d).alias("mean_abs_difference"), F.max(d).alias("max_abs_difference"), F.sum(d).alias("l1_distance"),
        F.max(F.col("margin_right") - F.col("margin_left")).alias("margin_change"),
        F.max((F.col("top1_group_left") == F.col("top1_group_right")).cast("int")).alias("same_top1"),
    )
    agree = classes.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_classes"), F.sum("same_top1").alias("n_same_top1"), F.avg("same_top1").alias("top1_agreement"))
    pearson = both.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_cells"), correlation("share_left", "share_right").alias("pearson"))
    rho = spearman(both, "share_left", "share_right", PAIR, bounded=True).drop("n")
    tau = kendall_tau_b(both, "share_left", "share_right", PAIR, [group_class, "group"], bounded=True, written=True).drop("n")
    return classes, agree.join(pearson, PAIR).join(rho, PAIR).join(tau, PAIR)


# --- sampling draws -------------------------------------------------------------------------

def sample_composition(
    df: DataFrame, draw: str, site: str, years: Sequence[int], classes: Mapping[str, object], group_class: str, year: str = "year", month: str = "month"
) -> DataFrame:
    """Per draw: sizes, samples per site, and counts per year, month and class, wide."""
    y, m = F.col(year), F.col(month)
    wide = [F.count(F.when(y == v, 1)).alias(f"year_{v}") for v in years]
    wide += [F.count(F.when(m == v, 1)).alias(f"month_{v:02d}") for v in range(1, 13)]
    wide += [F.count(F.when(F.col(group_class) == F.lit(v), 1)).alias(f"class_{n}") for n, v in classes.items()]
    base = df.groupBy(draw).agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct(year, month).alias("n_year_months"), *wide)
    per = df.groupBy(draw, site).agg(F.count(F.lit(1)).alias("_k")).groupBy(draw, "_k").agg(F.count(F.lit(1)).alias("_f"))
    sites = per.groupBy(draw).agg(
        F.sum("_f").alias("n_sites"), (F.sum(F.col("_k") * F.col("_f")) / F.sum("_f")).alias("samples_per_site_mean"),
        F.percentile("_k", F.lit(0.5), F.col("_f")).alias("samples_per_site_median"), F.min("_k").alias("samples_per_site_min"), F.max("_k").alias("samples_per_site_max"),
    )
    return base.join(sites, draw)


def _pair_cells(draws: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(draws, 2))


def pairwise_overlap(df: DataFrame, draw: str, draws: Sequence[str], keys: Sequence[str], month: str = "month") -> DataFrame:
    """Shared keys, their proportions, and total variation distance of the months, per pair of draws.

    Keys carry the set of draws that contain them; a generator lists the fixed pairs.
    """
    has = {d: F.max((F.col(draw) == d).cast("int")) for d in draws}
    per = df.where(F.col(draw).isin(list(draws))).groupBy(*keys).agg(*[c.alias(f"_h{i}") for i, c in enumerate(has.values())])
    cells = [F.struct(F.lit(a).alias("set_a"), F.lit(b).alias("set_b"), F.col(f"_h{draws.index(a)}").alias("_a"), F.col(f"_h{draws.index(b)}").alias("_b")) for a, b in _pair_cells(draws)]
    shared = per.select(F.inline(F.array(*cells))).groupBy("set_a", "set_b").agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_b")).alias("n_shared")
    )
    counts = df.where(F.col(draw).isin(list(draws))).groupBy(month).agg(*[F.count(F.when(F.col(draw) == d, 1)).alias(f"_c{i}") for i, d in enumerate(draws)])
    mcells = [F.struct(F.lit(a).alias("set_a"), F.lit(b).alias("set_b"), F.col(f"_c{draws.index(a)}").alias("_a"), F.col(f"_c{draws.index(b)}").alias("_b")) for a, b in _pair_cells(draws)]
    months = counts.select(month, F.inline(F.array(*mcells)))
    sizes = months.groupBy("set_a", "set_b").agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    tvd = months.join(sizes, ["set_a", "set_b"]).groupBy("set_a", "set_b").agg(
        (F.lit(0.5) * F.sum(F.abs(safe_divide("_a", "_ta") - safe_divide("_b", "_tb")))).alias("month_tvd")
    )
    return (
        shared.join(tvd, ["set_a", "set_b"]).withColumn("proportion_a", safe_divide("n_shared", "n_a")).withColumn("proportion_b", safe_divide("n_shared", "n_b"))
    )


def month_differences(df: DataFrame, draw: str, draws: Sequence[str], period: str) -> DataFrame:
    """Counts per calendar value in both draws of each pair and their difference."""
    counts = df.where(F.col(draw).isin(list(draws))).groupBy(period).agg(*[F.count(F.when(F.col(draw) == d, 1)).alias(f"_c{i}") for i, d in enumerate(draws)])
    cells = [F.struct(F.lit(a).alias("set_a"), F.lit(b).alias("set_b"), F.col(f"_c{draws.index(a)}").alias("count_a"), F.col(f"_c{draws.index(b)}").alias("count_b")) for a, b in _pair_cells(draws)]
    return counts.select(period, F.inline(F.array(*cells))).withColumn("difference", F.col("count_b") - F.col("count_a"))


def within_site_overlap(df: DataFrame, draw: str, draws: Sequence[str], site: str, year: str = "year", month: str = "month") -> DataFrame:
    """Per pair of draws and shared site: overlap and Jaccard of year-months and of months.

    Membership per (site, year, month) and per (site, month) is one aggregate each.
    """
    pairs = _pair_cells(draws)

    def overlap(keys: Sequence[str], prefix: str) -> DataFrame:
        per = df.where(F.col(draw).isin(list(draws))).groupBy(site, *keys).agg(*[F.max((F.col(draw) == d).cast("int")).alias(f"_h{i}") for i, d in enumerate(draws)])
        cells = [F.struct(F.lit(a).alias("set_a"), F.lit(b).alias("set_b"), F.col(f"_h{draws.index(a)}").alias("_a"), F.col(f"_h{draws.index(b)}").alias("_b")) for a, b in pairs]
        both = F.sum(F.col("_a") * F.col("_b"))
        either = F.sum(F.greatest("_a", "_b"))
        return per.select(site, F.inline(F.array(*cells))).groupBy("set_a", "set_b", site).agg(
            F.sum("_a").alias(f"{prefix}_a"), F.sum("_b").alias(f"{prefix}_b"), both.alias(f"{prefix}_shared"),
            (both / F.when(either > 0, either)).alias(f"{prefix}_jaccard"),
        ).where((F.col(f"{prefix}_a") > 0) & (F.col(f"{prefix}_b") > 0))

    return overlap([year, month], "year_month").join(overlap([month], "month"), ["set_a", "set_b", site])


def within_site_summary(detail: DataFrame) -> DataFrame:
    """Quartiles, IQR and extremes over sites, long in metric, with the zero / <=1 / >=2 overlap fractions."""
    metrics = ["year_month_shared", "year_month_jaccard", "month_shared", "month_jaccard"]
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = detail.select("set_a", "set_b", "year_month_shared", F.inline(F.array(*cells)))
    by = ["set_a", "set_b", "metric"]
    q = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).withColumnRenamed("n", "matched_sites")
    s = F.col("year_month_shared")
    rest = long.groupBy(*by).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg((s == 0).cast("int")).alias("fraction_zero"),
        F.avg((s <= 1).cast("int")).alias("fraction_le_1"), F.avg((s >= 2).cast("int")).alias("fraction_ge_2"),
    )
    return q.withColumn("iqr", F.col("q3") - F.col("q1")).join(rest, by)
