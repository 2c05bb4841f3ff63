"""Cluster resampling from per-cluster sufficient statistics.

Raw rows are never resampled. A replicate is a multiplicity per cluster, and the sums of a replicate are the weighted sums
of its clusters: every block of LEAF clusters multiplies (replicates x clusters) with (clusters x sums), and a task adds up
its blocks before the shuffle, so what moves is one row per replicate, level and task, however many clusters there are.

Two kinds of draws, both independent of partitioning and recomputed identically after a failure. `hash` draws are hashes
of (seed, replicate, position), which other engines can repeat; every draw travels once to the block it hits, as four
bytes of a packed row. `split` draws deal the n draws of a replicate down a binary tree of cluster blocks, binomially and
seeded per node, so a block makes its own multiplicities and no draw is ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import safe_divide, to_long
from panelwright.functions.hashing import md5_60_bits
from panelwright.operators.metrics import METRICS, SUMS, metrics_from_sums
from panelwright.operators.ordering import average_rank, dense_index
from panelwright.operators.temporal import section_starts
from panelwright.session import cut_lineage, share_package


def index_clusters(df: DataFrame, cluster: Sequence[str], stratum: Sequence[str] = ()) -> DataFrame:
    """Distinct clusters with a dense position `_pos` and the count `_n` (within the stratum, if any)."""
    share_package(df.sparkSession)  # the workers that draw import this package
    units = df.select(*stratum, *cluster).distinct()
    placed = dense_index(units, list(cluster), "_pos", by=stratum)
    if stratum:
        sizes = units.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n"))
        return placed.join(sizes, list(stratum))
    return placed.withColumn("_n", units.select(F.count(F.lit(1))).scalar())


#: Clusters of a block, the leaf of the tree of split draws, and hash draws that a task packs at a time.
LEAF, HELD = 256, 2_000_000


def _generator(*parts: object) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=16).digest(), "little")))


def split_counts(n: int, block: int, reps: int, seed: int, stratum: tuple = (), leaf: int = LEAF) -> np.ndarray:
    """(reps, clusters of the block): how often each is among the n draws of every replicate.

    From the root, all n draws are dealt to the two halves of a node's blocks in proportion to their clusters; at the leaf
    they are dealt to its clusters. A node's generator depends on the seed and the node alone, so whoever computes a
    block finds the same counts and the blocks of a replicate add up to exactly n.
    """
    lo, hi = 0, -(-n // leaf)
    counts = np.full(reps, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _generator(seed, stratum, lo, hi).binomial(counts, (mid - lo) * leaf / (min(hi * leaf, n) - lo * leaf))
        counts, lo, hi = (left, lo, mid) if block < mid else (counts - left, mid, hi)
    width = min(hi * leaf, n) - lo * leaf
    return _generator(seed, stratum, lo, "leaf").multinomial(counts, np.full(width, 1.0 / width))


def _kinds(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema]


def _picks(indexed: DataFrame, reps: int, seed: int, stratum: Sequence[str] = (), positions: bool = False) -> DataFrame:
    """The hash draws, packed by the block of clusters they hit: (stratum, _blk, _at, with `positions` also _by).

    Position p of replicate r draws the cluster md5('seed:stratum:r:p') mod n. A task makes all replicates of its positions,
    some HELD draws at a time, and packs those that hit one block into a row: `_at` holds (r - 1) * LEAF + place in the
    block as 32-bit integers, `_by` the positions as 64-bit integers.
    """
    if reps * LEAF >= 2**32:
        raise ValueError(f"at most {2**32 // LEAF - 1} replicates")
    head = F.concat_ws(":", F.lit(str(seed)), *[F.col(s).cast("string") for s in stratum])
    step = max(1, HELD // reps)
    width = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seats = indexed.select(*stratum, head.alias("_head"), F.col("_pos").alias("_seat"), "_n").repartition(width, "_seat").sortWithinPartitions("_head")
    names = [*stratum, "_blk", "_at", *(["_by"] if positions else [])]
    schema = ", ".join([*_kinds(indexed, stratum), "_blk long", "_at binary", *(["_by binary"] if positions else [])])

    def packed(part: pa.RecordBatch) -> pa.RecordBatch:
        n, seat = part.column("_n")[0].as_py(), np.sort(part.column("_seat").to_numpy())
        block, place = np.divmod(md5_60_bits(part.column("_head")[0].as_py(), np.arange(1, reps + 1), seat) % np.uint64(n), np.uint64(LEAF))
        at = (place + (np.arange(reps, dtype=np.uint64) * np.uint64(LEAF))[:, None]).astype("<u4").ravel()
        block = block.ravel().astype(np.uint16 if n <= LEAF * 2**16 else np.int64)
        order = np.argsort(block, kind="stable")
        hit, ends = np.unique(block[order], return_index=True)
        cells = [at[order], np.tile(seat.astype("<i8"), reps)[order]] if positions else [at[order]]
        parts = [pa.array([x.tobytes() for x in np.split(c, ends[1:])], pa.binary()) for c in cells]
        heads = [pa.array([part.column(s)[0].as_py()] * len(hit), part.schema.field(s).type) for s in stratum]
        return pa.RecordBatch.from_arrays([*heads, pa.array(hit.astype(np.int64)), *parts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in batch.column("_head").value_counts().field("counts").to_pylist() if batch.num_rows else []:
                mine, batch = batch.slice(0, length), batch.slice(length)
                for lo in range(0, length, step):
                    yield packed(mine.slice(lo, step))

    return seats.mapInArrow(run, schema)


def _codes(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in table.column(column).to_pylist()]])


def _per_block(
    rows: DataFrame, indexed: DataFrame, reps: int, seed: int, stratum: Sequence[str], draws: str, schema: str, make: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]
) -> DataFrame:
    """`make(rows, counts, column)` of every block of LEAF clusters.

    `rows` hold stratum, `_pos`, `_n` and what `make` needs; `counts` (replicates x clusters of the block) tells how often each
    is drawn, `column` which of them a row belongs to. A block has some reps * LEAF draws, however many clusters there are.
    """
    keys = [*stratum, "_blk"]
    placed = rows.withColumn("_blk", F.floor(F.col("_pos") / LEAF).cast("long")).groupBy(*keys)

    def column(key: tuple, table: pa.Table) -> np.ndarray:
        return table.column("_pos").to_numpy() - key[-1].as_py() * LEAF

    if draws == "split":

        def deal(key: tuple, table: pa.Table) -> pa.Table:
            *levels, block = [k.as_py() for k in key]
            return make(table, split_counts(table.column("_n")[0].as_py(), block, reps, seed, tuple(levels)), column(key, table))

        return placed.applyInArrow(deal, schema)

    def count(key: tuple, table: pa.Table, picked: pa.Table) -> pa.Table:
        counts = np.bincount(_codes(picked, "_at", "<u4"), minlength=reps * LEAF).reshape(reps, LEAF)
        return make(table, counts, column(key, table))

    return placed.cogroup(_picks(indexed, reps, seed, stratum).groupBy(*keys)).applyInArrow(count, schema)


def multiplicities(df: DataFrame, cluster: Sequence[str], reps: int, seed: int, stratum: Sequence[str] = (), draws: str = "hash") -> DataFrame:
    """How often each cluster is drawn in each replicate; undrawn clusters are absent."""
    indexed = index_clusters(df, cluster, stratum)
    names = [*stratum, "rep", *cluster, "multiplicity"]

    def make(table: pa.Table, counts: np.ndarray, column: np.ndarray) -> pa.Table:
        rep, row = np.nonzero(counts[:, column])
        taken = {c: table.column(c).take(pa.array(row)) for c in (*stratum, *cluster)}
        return pa.table({"rep": (rep + 1).astype(np.int32), "multiplicity": counts[:, column][rep, row].astype(np.int64), **taken}).select(names)

    schema = ", ".join([*_kinds(indexed, stratum), "rep int", *_kinds(indexed, cluster), "multiplicity long"])
    return _per_block(indexed, indexed, reps, seed, stratum, draws, schema, make)


def replicate_counts(df: DataFrame, cluster: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(cluster, counts): how often a cluster is drawn in replicate 1, 2, ..., as one array."""
    indexed = index_clusters(df, cluster)

    def make(table: pa.Table, counts: np.ndarray, column: np.ndarray) -> pa.Table:
        drawn = pa.array(list(counts[:, column].T.astype(np.int32)), pa.list_(pa.int32()))
        return table.select(list(cluster)).append_column("counts", drawn)

    return _per_block(indexed, indexed, reps, seed, [], "hash", ", ".join([*_kinds(indexed, cluster), "counts array<int>"]), make)


def replicate_sums(
    stats: DataFrame, cluster: Sequence[str], sums: Sequence[str], reps: int, seed: int, by: Sequence[str] = (), stratum: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Sums per (stratum, rep, by). All `by` levels, a handful, share the same draws.

    The statistics are materialised once: they are far smaller than the rows behind them and are read for the index and
    for the join. See the head of this module. Sums must not be null.
    """
    stats = cut_lineage(stats.select(*stratum, *cluster, *by, *[F.col(c).cast("double").alias(c) for c in sums]))
    indexed = index_clusters(stats, cluster, stratum)
    names = [*stratum, *by, "rep", *sums]

    def make(table: pa.Table, counts: np.ndarray, column: np.ndarray) -> pa.Table:
        values = np.column_stack([table.column(c).to_numpy() for c in sums])
        levels = list(zip(*[table.column(c).to_pylist() for c in by])) if by else [()] * len(values)
        held: dict[tuple, list[int]] = {}
        for i, level in enumerate(levels):
            held.setdefault(level, []).append(i)
        parts = []
        for level, mine in (held or {(None,) * len(by): []}).items():
            weights = counts[:, column[mine]].astype(float)
            on = np.flatnonzero(weights.any(axis=1))
            heads = [(c, v) for c in stratum for v in table.column(c).to_pylist()[:1]] + list(zip(by, level))
            fixed = {c: pa.array([v] * len(on), table.schema.field(c).type) for c, v in heads}
            total = weights[on] @ values[mine]
            parts.append(pa.table({**fixed, "rep": (on + 1).astype(np.int32), **{c: total[:, i] for i, c in enumerate(sums)}}).select(names))
        return pa.concat_tables(parts)

    schema = ", ".join([*_kinds(stats, [*stratum, *by]), "rep int", *[f"`{c}` double" for c in sums]])
    rows = stats.join(indexed, [*stratum, *cluster]).select(*stratum, "_pos", "_n", *by, *sums)
    partial = _per_block(rows, indexed, reps, seed, stratum, draws, schema, make)
    return partial.groupBy(*stratum, "rep", *by).agg(*[F.sum(s).alias(s) for s in sums])


def cluster_bootstrap(stats: DataFrame, cluster: Sequence[str], reps: int, seed: int, by: Sequence[str] = (), draws: str = "hash") -> DataFrame:
    """Replicate metrics (rep, by, metrics)."""
    return metrics_from_sums(replicate_sums(stats, cluster, SUMS, reps, seed, by, draws=draws), ["rep", *by])


def multi_seed_bootstrap(
    stats: DataFrame, cluster: Sequence[str], reps: int, seed: int, model_seed: str = "seed", by: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Metric per model seed inside each replicate, then the mean over model seeds."""
    per = cluster_bootstrap(stats, cluster, reps, seed, [*by, model_seed], draws)
    return per.groupBy("rep", *by).agg(*[F.avg(m).alias(m) for m in METRICS])


def paired_differences(replicates: DataFrame, side: str, candidate: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """candidate - reference of each metric in each replicate, long: (rep, by, metric, difference)."""
    def of(level: str, m: str) -> Column:
        return F.max(F.when(F.col(side) == level, F.col(m)))

    wide = replicates.groupBy("rep", *by).agg(*[(of(candidate, m) - of(reference, m)).alias(m) for m in METRICS])
    return to_long(wide, ["rep", *by], METRICS, "metric", "difference")


def percentile_interval(
    draws: DataFrame, by: Sequence[str], value: str, lower: float = 0.025, upper: float = 0.975
) -> DataFrame:
    """Linear-interpolated percentile interval with an includes-zero flag.

    A group holds one value per replicate, so its size is the replicate count.
    """
    out = draws.groupBy(*by).agg(
        F.count(value).alias("replicates"), F.percentile(value, lower).alias("lower"), F.percentile(value, upper).alias("upper")
    )
    return out.withColumn("includes_zero", (F.col("lower") <= 0) & (F.col("upper") >= 0))


def metrics_long(df: DataFrame, keep: Sequence[str], value: str = "value") -> DataFrame:
    return to_long(df, keep, METRICS, "metric", value)


def interval_table(points: DataFrame, draws: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Point estimates with their percentile intervals; both long in (by..., value)."""
    return points.join(percentile_interval(draws, by, value), list(by))


def draw_sequence(df: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """Draw table: (attempt, draw_id, draw_position, cluster, copy, series_id). A block of clusters numbers its own copies."""
    indexed = index_clusters(df, [cluster])

    def number(key: tuple, table: pa.Table, picked: pa.Table) -> pa.Table:
        at, seat = _codes(picked, "_at", "<u4"), _codes(picked, "_by", "<i8")
        order = np.lexsort((seat, at))
        at, seat = at[order], seat[order]
        _, first, times = np.unique(at, return_index=True, return_counts=True)
        copy = np.arange(len(at)) - np.repeat(first, times) + 1
        sites = table.sort_by("_pos").column(cluster).take(pa.array(at % LEAF))
        return pa.table({"attempt": (at // LEAF + 1).astype(np.int32), "draw_position": seat + 1, cluster: sites, "copy": copy.astype(np.int32)})

    placed = indexed.withColumn("_blk", F.floor(F.col("_pos") / LEAF).cast("long")).groupBy("_blk")
    rows = placed.cogroup(_picks(indexed, reps, seed, positions=True).groupBy("_blk")).applyInArrow(
        number, ", ".join(["attempt int", "draw_position long", *_kinds(indexed, [cluster]), "copy int"])
    )
    return rows.select(
        "attempt", F.format_string("draw_%04d", "attempt").alias("draw_id"), "draw_position", cluster, "copy",
        F.format_string("%s_copy%02d", F.col(cluster).cast("string"), F.col("copy")).alias("series_id"),
    )


def resample_panel(df: DataFrame, draws: DataFrame, cluster: str, time: str) -> DataFrame:
    """The rows of every drawn copy, sections restarting per copy: a copy has all rows of its cluster, so they are marked once."""
    return section_starts(df, [cluster], time).join(draws.select("attempt", cluster, "copy"), cluster)


def resampled_counts(df: DataFrame, cluster: str, time: str, reps: int, seed: int) -> DataFrame:
    """(attempt, n_rows, n_sections, n_series) of the panels of `draw_sequence`, from sums per cluster: no row is copied."""
    per = section_starts(df, [cluster], time).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("section_start").cast("int")).alias("n_sections")
    )
    sums = replicate_sums(per.withColumn("n_series", F.lit(1)), [cluster], ["n_rows", "n_sections", "n_series"], reps, seed)
    return sums.select(F.col("rep").alias("attempt"), *[F.col(c).cast("long").alias(c) for c in ("n_rows", "n_sections", "n_series")])


def simultaneous_interval(estimates: DataFrame, draws: DataFrame, name: str, value: str, level: float = 0.95) -> DataFrame:
    """Marginal percentile and simultaneous max-|z| intervals of a fixed set of contrasts."""
    sds = draws.groupBy(name).agg(
        F.stddev_samp(value).alias("sd"), F.percentile(value, 0.025).alias("marginal_lower"), F.percentile(value, 0.975).alias("marginal_upper"),
        F.count(value).alias("replicates"),
    )
    frame = estimates.join(sds, name)
    z = draws.join(frame.select(name, "estimate", "sd"), name).withColumn("_z", F.abs(safe_divide(F.col(value) - F.col("estimate"), F.col("sd"))))
    critical = z.groupBy("rep").agg(F.max("_z").alias("_m")).select(F.percentile("_m", level)).scalar()
    return frame.withColumn("critical", critical).select(
        name, "estimate", "sd", "marginal_lower", "marginal_upper",
        (F.col("estimate") - F.col("critical") * F.col("sd")).alias("simultaneous_lower"),
        (F.col("estimate") + F.col("critical") * F.col("sd")).alias("simultaneous_upper"), "critical", "replicates",
    )


# --- stratified resampling of entity tables -------------------------------------------------

def stratified_replicates(
    df: DataFrame, stratum: str, cluster: str, group: str, value: str, reps: int, seed: int, extra: Sequence[str] = (), by: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Mean of `value` (and `extra`) per (stratum, by, rep, group) over clusters redrawn within their stratum.

    `df` is long: one row per (stratum, cluster, by, group), every cluster holding every group. All levels of `by` (runs,
    say) see the same draws.
    """
    stats = df.withColumn("_k", F.lit(1.0))
    sums = replicate_sums(stats, [cluster], [value, *extra, "_k"], reps, seed, [*by, group], [stratum], draws)
    return sums.select(stratum, *by, "rep", group, *[(F.col(c) / F.col("_k")).alias(c) for c in (value, *extra)])


def stratified_bootstrap(
    df: DataFrame, stratum: str, cluster: str, group: str, value: str, dominant: str, reps: int, seed: int, by: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Intervals of group means and of the share of clusters a group dominates (`dominant` is 0/1)."""
    keys = [stratum, *by, group]
    df = cut_lineage(df.select(*keys, cluster, value, dominant))
    point = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), F.avg(value).alias("mean"), F.avg(dominant).alias("proportion"))
    drawn = stratified_replicates(df, stratum, cluster, group, value, reps, seed, [dominant], by, draws)
    ci = drawn.groupBy(*keys).agg(
        F.percentile(value, 0.025).alias("mean_lower"), F.percentile(value, 0.975).alias("mean_upper"),
        F.percentile(dominant, 0.025).alias("proportion_lower"), F.percentile(dominant, 0.975).alias("proportion_upper"),
    )
    return point.join(ci, keys)


def share_bootstrap(
    df: DataFrame, stratum: str, cluster: str, group: str, value: str, reps: int, seed: int, by: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Interval of each group's share of the stratum total."""
    def share(rows: DataFrame, within: Sequence[str]) -> DataFrame:
        # a handful of groups per partition
        total = F.sum(value).over(Window.partitionBy(*within))
        return rows.withColumn("share", safe_divide(F.col(value), total))

    keys = [stratum, *by, group]
    df = cut_lineage(df.select(*keys, cluster, value))
    point = share(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), F.avg(value).alias(value)), [stratum, *by])
    drawn = share(stratified_replicates(df, stratum, cluster, group, value, reps, seed, by=by, draws=draws), [stratum, *by, "rep"])
    ci = drawn.groupBy(*keys).agg(F.percentile("share", 0.025).alias("lower"), F.percentile("share", 0.975).alias("upper"))
    return point.select(*keys, "n_sites", "share").join(ci, keys)


def rank_replicates(
    df: DataFrame, cluster: str, entity: str, total: str, count: str, reps: int, seed: int, by: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Importance (sum / count over redrawn clusters) and its average-tie rank per replicate and level of `by`."""
    sums = replicate_sums(df, [cluster], [total, count], reps, seed, [*by, entity], draws=draws)
    values = sums.select("rep", *by, entity, safe_divide(total, count).alias("importance"))
    return average_rank(values, "importance", "rank", by=["rep", *by], descending=True, bounded=True)


def rank_bootstrap(
    df: DataFrame, cluster: str, entity: str, total: str, count: str, reps: int, seed: int, top: int = 5, by: Sequence[str] = (), draws: str = "hash"
) -> DataFrame:
    """Importance interval, rank distribution summary and probability of a rank within `top`."""
    keys = [*by, entity]
    df = cut_lineage(df.select(cluster, *keys, total, count))
    point = df.groupBy(*keys).agg(safe_divide(F.sum(total), F.sum(count)).alias("importance"))
    r = rank_replicates(df, cluster, entity, total, count, reps, seed, by, draws)
    q = {"rank_p025": 0.025, "rank_q25": 0.25, "median_rank": 0.5, "rank_q75": 0.75, "rank_p975": 0.975}
    summary = r.groupBy(*keys).agg(
        F.percentile("importance", 0.025).alias("lower"), F.percentile("importance", 0.975).alias("upper"), F.avg("rank").alias("mean_rank"),
        *[F.percentile("rank", p).alias(k) for k, p in q.items()], F.avg((F.col("rank") <= top).cast("int")).alias("top_probability"),
        F.count(F.lit(1)).alias("replicates"),
    )
    return point.join(summary, keys)


def rank_distribution(ranks: DataFrame, entity: str, reps: int, by: Sequence[str] = ()) -> DataFrame:
    """Probability of each rank per entity."""
    return ranks.groupBy(*by, entity, "rank").agg((F.count(F.lit(1)) / F.lit(float(reps))).alias("probability"))


def relative_difference(reference: Column, candidate: Column) -> Column:
    """Percent difference relative to the absolute reference."""
    return F.lit(100.0) * (candidate - reference) / F.when(reference != 0, F.abs(reference))
