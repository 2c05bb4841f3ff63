"""Nearest neighbours by cosine: a vantage-point tree per shard, searched with relaxed triangle pruning.

Unit vectors are compared by their chord, a metric that falls as the cosine rises. A query leaves out a leaf when the
triangle inequality at a vantage row above puts everything in it further than `factor` times its k-th best so far; factor 1
is exact, smaller factors visit fewer leaves. In a leaf, products in single precision leave out what their error bound
excludes; scores are cosines of the original vectors in double precision, summed component by component. Every row is
indexed. A task holds one block of queries and passes a group of trees, so that bounds found in one tree hold in the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from panelwright.session import cut_lineage

SHARD, LEAF = 4096, 64
#: A tile: bytes of queries and of trees (as doubles), and pairs of a query and a row, some 10 s, that one task takes at most.
QUERY_BYTES, TREE_BYTES, PAIRS = 1 << 24, 1 << 26, 1 << 31
TILES = 32  # at least, if there are as many trees
_ROWS = 8192  # queries that visit a tree together
_CELLS = 1 << 20  # components of the pairs that are scored together
_SLACK = 1e-6  # more than rounding can move a chord
_NONE = np.iinfo(np.int64).max


def running_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of a and b, added in the order of the components."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += a[:, k, None] * b[None, :, k]
    return out


def norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * a[:, k]
    return np.sqrt(out)


def scaled(a: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 0.5 to 1.

    Cosines keep their bits, as only exponents change, and squares neither overflow nor vanish.
    """
    _, exponents = np.frexp(np.abs(a).max(axis=1, initial=0.0))
    return np.ldexp(a, -exponents[:, None])


def _grow(units: np.ndarray, order: np.ndarray, nodes: list, radii: list, leaf: int, random: np.random.Generator, lo: int, hi: int) -> int:
    """Add the node of order[lo:hi] and those below. No inner function: one that calls itself keeps its arrays until a collection."""
    me = len(nodes)
    nodes.append([lo, hi, -1, -1, -1])
    radii.append(0.0)
    if hi - lo > leaf:
        vantage = order[lo + int(random.integers(hi - lo))]
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * units[order[lo:hi]] @ units[vantage]))
        by = np.argsort(far, kind="stable")
        radius = far[by[(hi - lo) // 2 - 1]]
        inside = int(np.searchsorted(far[by], radius, "right"))
        if inside < hi - lo:
            order[lo:hi] = order[lo:hi][by]
            nodes[me][2], radii[me] = int(vantage), float(radius)
            nodes[me][3] = _grow(units, order, nodes, radii, leaf, random, lo, lo + inside)
            nodes[me][4] = _grow(units, order, nodes, radii, leaf, random, lo + inside, hi)
    return me


class VantageTree:
    """Nodes as arrays: a node has a vantage row, a radius and children, or is a leaf with a slice of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, radii: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors, self.nodes, self.radii, self.order = ids, vectors, nodes, radii, order
        self.norms = norms(vectors)
        self.units = vectors / self.norms[:, None]
        self.narrow = self.units.astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> VantageTree:
        """Median splits around a random vantage row; rows that all lie equally far stay one leaf. `order` tells where rows were."""
        units = vectors / norms(vectors)[:, None]
        order, nodes, radii = np.arange(len(ids)), [], []
        _grow(units, order, nodes, radii, leaf, np.random.default_rng(len(ids)), 0, len(ids))
        nodes = np.array(nodes, np.int32)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        split = nodes[:, 2] >= 0
        nodes[split, 2] = place[nodes[split, 2]]
        return cls(ids[order], vectors[order], nodes, np.array(radii), order)

    def leaves(self, units: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per leaf (first row, end, home, bound): which queries belong there, and how far its rows are from each at least."""
        split = np.flatnonzero(self.nodes[:, 2] >= 0)
        gaps = np.empty((len(self.nodes), len(units)))
        gaps[split] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.units[self.nodes[split, 2]] @ units.T)) - self.radii[split, None]
        yield from self._below(0, gaps, np.ones(len(units), bool), np.zeros(len(units)))

    def _below(self, node: int, gaps: np.ndarray, home: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        lo, hi, vantage, inner, outer = self.nodes[node].tolist()
        if vantage < 0:
            yield lo, hi, home, bound
        else:
            near = gaps[node] <= 0
            yield from self._below(inner, gaps, home & near, np.maximum(bound, gaps[node]))
            yield from self._below(outer, gaps, home & ~near, np.maximum(bound, -gaps[node]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, found) of the k best rows per query, best first, ties to the smaller id, without the query's own."""
        best = Best(query_ids, queries, k)
        best.search(self, factor)
        return best.scores, best.found, ~np.isneginf(best.scores)


class Best:
    """The k best rows so far of a block of queries of one dimension; trees are searched one after the other."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.dims = ids, vectors, k, vectors.shape[1]
        self.lengths = norms(vectors)
        self.units = vectors / self.lengths[:, None]
        self.narrow = self.units.astype(np.float32)
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NONE)
        self.error = (self.dims + 8) * 2.0**-23  # twice what single precision can move a cosine

    def search(self, tree: VantageTree, factor: float) -> None:
        """Every query visits the leaf it belongs to, then those that its k-th best so far does not exclude."""
        for a in range(0, len(self.ids), _ROWS):
            leaves = list(tree.leaves(self.units[a : a + _ROWS]))
            for lo, hi, home, _ in leaves:
                self.visit(tree, lo, hi, a, home)
            for lo, hi, home, bound in leaves:
                worst = self.scores[a : a + _ROWS, -1]
                full = ~np.isneginf(worst)
                reach = np.where(full, factor * np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.where(full, worst, 0.0))), np.inf)
                self.visit(tree, lo, hi, a, ~home & (bound <= reach + _SLACK))

    def visit(self, tree: VantageTree, lo: int, hi: int, first: int, chosen: np.ndarray) -> None:
        """Compare the chosen ones of the queries from `first` on with a leaf's rows."""
        count = np.count_nonzero(chosen)
        most = 2 * count > len(chosen)  # then products of all take less time than a copy of the chosen
        rows = np.arange(first, first + len(chosen)) if most else first + np.flatnonzero(chosen)
        units = self.narrow[first : first + len(chosen)] if most else self.narrow[rows]
        for a in range(lo, hi if count else lo, 4 * LEAF):
            b = min(hi, a + 4 * LEAF)
            close, least = units @ tree.narrow[a:b].T, self.scores[rows, -1]
            if b - a > self.k and np.isneginf(least).any():
                others = np.where(tree.ids[None, a:b] == self.ids[rows, None], -np.inf, close)
                least = np.maximum(least, np.partition(others, -self.k, axis=1)[:, -self.k] - self.error)
            least = np.where(chosen, least, np.inf) if most else least
            pairs = np.flatnonzero(close >= (least - self.error).astype(np.float32)[:, None])
            step = max(1, _CELLS // self.dims)
            for c in range(0, len(pairs), step):
                i, j = np.divmod(pairs[c : c + step], b - a)
                self.score(tree, rows[i], a + j)

    def score(self, tree: VantageTree, i: np.ndarray, j: np.ndarray) -> None:
        """Score pairs of a query i and a row j, and keep the k best of each query."""
        other = tree.ids[j] != self.ids[i]
        i, j = i[other], j[other]
        s = 0.0 + np.add.accumulate(self.vectors[i] * tree.vectors[j], axis=1)[:, -1]  # as running_dot adds
        s /= self.lengths[i] * tree.norms[j]
        better = (s > self.scores[i, -1]) | (s == self.scores[i, -1]) & (tree.ids[j] < self.found[i, -1])
        i, ids, s = i[better], tree.ids[j[better]], s[better]
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, self.k), i])
        ids, s = np.concatenate([self.found[rows].ravel(), ids]), np.concatenate([self.scores[rows].ravel(), s])
        order = np.lexsort((ids, -s, i))
        top = order[np.searchsorted(i[order], rows)[:, None] + np.arange(self.k)]
        self.scores[rows], self.found[rows] = s[top], ids[top]


INDEX_SCHEMA = "role int, at int, n int, dims int, ids binary, vectors binary, nodes binary, radii binary"
_QUERIES, _TREE = 0, 1
_SENT = "role", "dims", "ids", "vectors", "nodes", "radii"


def usable_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector of floats or else doubles), each once; null, zero, and non-finite vectors and rows without an id take no part."""
    kind = embeddings.select(vector).schema[0].dataType
    v = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).distinct()


def build_index(vectors: DataFrame, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """Rows (vec_id, vector, asked) as a row per tree of at most `shard` rows of one dimension, and one of its queries, if any.

    `at` counts a partition's trees, and the rows of their queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        made = [0, 0]

        def row(role: int, dims: int, ids: np.ndarray, rows: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
            made[role] += 1
            texts = [x.tobytes() for x in (ids, rows, *more)] + [None] * (2 - len(more))
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (role, made[role] - 1, len(ids), dims)), *(pa.array([x], pa.binary()) for x in texts)], names=["role", "at", "n", "dims", "ids", "vectors", "nodes", "radii"])

        def grown(dims: int) -> Iterator[pa.RecordBatch]:
            ids, rows, asked = map(np.concatenate, held.pop(dims))
            t = VantageTree.build(ids, scaled(rows.astype(np.float64)), leaf)
            yield row(_TREE, dims, t.ids, rows[t.order], t.nodes, t.radii)
            if asked.any():
                yield row(_QUERIES, dims, ids[asked], rows[asked])

        for batch in batches:
            ids, rows, asked = batch.column("vec_id").to_numpy(), batch.column("vector"), batch.column("asked").to_numpy(zero_copy_only=False)
            sizes = np.diff(rows.offsets.to_numpy())
            flat, starts = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()[:-1]
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                while len(at):
                    mine = held.setdefault(dims, ([], [], []))
                    take = at[: shard - sum(map(len, mine[0]))]
                    for to, x in zip(mine, (ids[take], flat[starts[take, None] + np.arange(dims)], asked[take])):
                        to.append(x)
                    at = at[len(take) :]
                    if sum(map(len, mine[0])) >= shard:
                        yield from grown(dims)
        for dims in list(held):
            yield from grown(dims)

    return vectors.mapInArrow(run, INDEX_SCHEMA)


def tiling(trees: int, tree_rows: int, tree_cells: int, query_rows: int, query_cells: int, tiles: int) -> tuple[int, int]:
    """Into how many groups trees and queries are dealt, so that a tile of both is bounded in bytes and pairs and there are `tiles`."""
    groups = max(1, -(-8 * query_cells // QUERY_BYTES))
    least = max(-(-tiles // groups), -(-8 * tree_cells // TREE_BYTES), -(-tree_rows * query_rows // groups // PAIRS), 1)
    return min(max(trees, 1), least), groups


def in_tiles(index: DataFrame, tiles: int) -> DataFrame:
    """Index rows by tile, a partition each, queries first: every group of queries meets every group of trees once."""
    tree, rows = F.col("role") == _TREE, F.col("n").cast("long")
    cells = rows * F.col("dims")
    totals = index.agg(F.count_if(tree), *(F.sum(F.when(is_in, x)) for is_in in (tree, ~tree) for x in (rows, cells)), F.max("part") + 1).first()
    *sizes, parts = (x or 0 for x in totals)
    tree_groups, query_groups = tiling(*sizes, tiles)
    spread = F.col("part") + F.col("at").cast("long") * F.lit(parts)  # counts a partition's first rows, then the second ones

    def one(groups: int) -> Column:
        return F.pmod(spread, F.lit(groups)).cast("int")

    def each(groups: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))

    trees = index.filter(tree).withColumn("_tree", one(tree_groups)).withColumn("_query", each(query_groups))
    queries = index.filter(~tree).withColumn("_tree", each(tree_groups)).withColumn("_query", one(query_groups))
    placed = trees.unionByName(queries).withColumn("tile", F.col("_query") * tree_groups + F.col("_tree"))
    return placed.select("tile", *_SENT).repartitionById(tree_groups * query_groups, F.col("tile")).sortWithinPartitions("tile", "role")


def nearest(embeddings: DataFrame, is_query: Column | str, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every query row.

    Vectors are scaled by powers of two, so huge and tiny components count as any others. Vectors that are null, empty, zero or have null or non-finite components take no part; vectors are compared with those
    of the same dimension; repeated rows count once; ties go to the smaller id; with fewer than k candidates all are
    returned; an empty table has no result. Trees and blocks of queries are dealt into tiles, one a task, of bounded sizes:
    nothing is joined or broadcast, the driver sees one row of totals, and only k rows per query and group of trees are
    shuffled.
    """
    usable = usable_vectors(embeddings, key, vector)
    cell = np.float32 if isinstance(usable.schema["vector"].dataType.elementType, FloatType) else np.float64
    asked = F.coalesce(F.expr(is_query) if isinstance(is_query, str) else is_query, F.lit(False))
    index = cut_lineage(build_index(usable.withColumn("asked", asked), shard).withColumn("part", F.spark_partition_id()))
    tiles = in_tiles(index, max(TILES, 3 * embeddings.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        best: dict[int, Best] = {}

        def ended() -> Iterator[pa.RecordBatch]:
            for b in best.values():
                found = ~np.isneginf(b.scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, found.sum(axis=1))), pa.array(b.found[found]), pa.array(b.scores[found])], names=["query_id", "vec_id", "score"])
            blocks.clear()
            best.clear()

        here = None
        for batch in batches:
            for i in range(batch.num_rows):
                now, role, dims = (batch.column(c)[i].as_py() for c in ("tile", "role", "dims"))
                if now != here:
                    yield from ended()
                    here = now
                ids, vectors, nodes, radii = (batch.column(c)[i].as_buffer() for c in ("ids", "vectors", "nodes", "radii"))
                ids, vectors = np.frombuffer(ids, np.int64), scaled(np.frombuffer(vectors, cell).reshape(-1, dims).astype(np.float64))
                if role == _QUERIES:
                    blocks.setdefault(dims, []).append((ids, vectors))
                    continue
                if dims in blocks:
                    best[dims] = Best(*map(np.concatenate, zip(*blocks.pop(dims))), k)
                if dims in best:
                    best[dims].search(VantageTree(ids, vectors, np.frombuffer(nodes, np.int32).reshape(-1, 5), np.frombuffer(radii)), factor)
        yield from ended()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vp_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS l FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND q.l > 0 AND c.l > 0 AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

QUERIES = {"op5_vp_search": op5_vp_search}
ORACLE = {"op5_vp_search": ORACLE_SQL}
