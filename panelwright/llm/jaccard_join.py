"""N-gram Jaccard self-join with adaptive multi-match prefixes (after AdaptJoin), exact, and its connected components.

Global order: shingles by the counts of a fixed-size sketch of the whole corpus, then by hash. A set of n shingles whose
partners share at least T of them has its l-prefix of n - T + l shingles share at least l with any partner's. Each
document picks the l that minimises an estimate of its candidate cost; before verification a pair must share the smaller
of its two l's. Candidates are drawn from the first n - T + 1 shingles, where a linked pair's first common one must be;
what stands before it in either set is missing in the other, and must leave enough for the overlap.

Identical sets are one class. Classes are first compared with one leader per prefix shingle (the member that has it
earliest), which joins most of a group of near copies without listing its pairs. What is left are pairs between different
components: these are all listed, filtered and verified. So no link between components is lost, and links inside one are
not needed for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components
from panelwright.llm.words import SPACES, Words, id_and_text, scan
from panelwright.session import cut_lineage

#: Counters of the sketch: a fixed amount of memory, whatever the corpus.
SKETCH_BITS = 20
_BLOCK = 1 << 12
#: Bits of the filter that picks the texts to verify.
FILTER_BITS = 20
#: Cost of verifying one candidate, in postings read; longest prefix extension tried.
VERIFY_COST, MOST_MATCHES = 50.0, 8
#: Pairs of one document that are verified in one run.
SALT_PAIRS = 512


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a piece; fewer than k words are one shingle, none is an empty set."""
    at, hashes = words.runs(k)
    cuts = np.searchsorted(at, words.bounds)
    for t in range(words.texts):
        a, b = words.bounds[t], words.bounds[t + 1]
        if b - a >= k:
            yield np.unique(hashes[cuts[t] : cuts[t + 1]])
        elif b > a:
            part = Words(0, words.data, words.starts[a:b], words.ends[a:b], np.array([0, b - a]), words.hashes[a:b])
            yield part.runs(int(b - a))[1]
        else:
            yield np.empty(0, np.uint64)


def shingle_sketch(documents: DataFrame, k: int) -> np.ndarray:
    """Occurrences of all shingles of the corpus in 2**SKETCH_BITS counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for words in scan(batch.column("text"), SPACES):
                total += np.bincount((words.runs(k)[1] & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        blocks = [b for b in range(len(total) // _BLOCK) if total[b * _BLOCK : (b + 1) * _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if block != at:
                    if at is not None:
                        yield _row(at, total)
                    at, total = block, np.zeros(_BLOCK, np.uint64)
                total += np.frombuffer(raw, np.uint32)
        if at is not None:
            yield _row(at, total)

    def _row(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["block", "counts"])

    parts = documents.mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in parts.collect():  # at most 256 rows of 16 KB
        sketch[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return sketch


def adaptive_prefix(shingles: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[int, np.ndarray]:
    """(l, the l-prefix in global order); no prefix if only an identical set can be linked.

    The l-prefix costs its postings and, since a candidate uses up at least l of them, at most postings / l verifications.
    """
    n = len(shingles)
    if 100 * n < percent * (n + 1):
        return 1, np.empty(0, np.uint64)
    least = -(-percent * n // 100)
    first, most = n - least + 1, min(MOST_MATCHES, least)
    order = np.lexsort((shingles, counts))[: first + most - 1]
    expected = np.cumsum(np.maximum(counts[order] - noise, 0.0))[first - 1 :]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(expected * (1.0 + VERIFY_COST / matches) + matches))
    return best + 1, shingles[order[: first + best]]


SET_SCHEMA = "doc_id long, set_key binary, n int"


def document_sets(documents: DataFrame, k: int, percent: int, sketch: np.ndarray | None) -> DataFrame:
    """(doc_id, set_key, n) and with a sketch (l, tokens): one row per document; null and empty texts have n = 0."""
    prefixes = sketch is not None
    shared = documents.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        noise = float(np.median(counters)) if prefixes else 0.0
        for batch in batches:
            for words in scan(batch.column("text"), SPACES):
                keys, sizes, matches, tokens = [], [], [], []
                for s in shingle_sets(words, k):
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sizes.append(len(s))
                    if prefixes:
                        best, prefix = adaptive_prefix(s, counters[(s & np.uint64(len(counters) - 1)).astype(np.int64)].astype(np.float64), noise, percent)
                        matches.append(best)
                        tokens.append(prefix.view(np.int64))
                columns = {"doc_id": batch.column("doc_id").slice(words.first, words.texts), "set_key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int32())}
                if prefixes:
                    offsets = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
                    columns |= {"l": pa.array(matches, pa.int32()), "tokens": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.mapInArrow(run, SET_SCHEMA + (", l int, tokens array<long>" if prefixes else ""))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _overlap_needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / F.lit(float(100 + percent)) - F.lit(1e-9))


def _texts_of(spark: SparkSession, documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents of the pairs and few others: a bit filter of fixed size keeps the rest from the shuffle."""
    bits = 1 << FILTER_BITS
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).cast("int").alias("bit")).distinct().toArrow()  # at most `bits` numbers
    mask = np.zeros(bits, bool)
    mask[wanted.column("bit").to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            keep = pa.array(known[batch.column("bit").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), batch.column("text").filter(keep)], names=["id", "text"])

    hashed = documents.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int").alias("bit"))
    return hashed.mapInArrow(run, "id long, text string").groupBy("id").agg(F.max("text").alias("text"))


def verified(documents: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link. Texts travel once per `a` and run of its pairs, and once per pair for `b`."""
    texts = _texts_of(documents.sparkSession, documents, pairs)
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SALT_PAIRS))).cast("int").alias("runs"))
    spread = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"))
    hubs = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run")).join(texts.withColumnRenamed("id", "a"), "a").select("a", "run", F.lit(None).cast("long").alias("b"), "text")
    others = spread.join(texts.withColumnRenamed("id", "b"), "b").select("a", "run", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint64)
        for batch in batches:
            a, b, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for words in scan(batch.column("text"), SPACES):
                for i, s in enumerate(shingle_sets(words, k), words.first):
                    if b[i] is None:
                        hub = s
                        continue
                    both = len(np.intersect1d(hub, s, assume_unique=True))
                    if 100 * both >= percent * (len(hub) + len(s) - both):
                        found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64())], names=["a", "b"])

    return hubs.unionByName(others).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `documents`.

    Sets hold the distinct k-word shingles of the whole text (words [^\\x20\\x09-\\x0D]+, A-Z folded); a text of fewer
    words is one shingle. Two documents link when 100 * intersection >= percent * union. Null and empty texts have no
    shingles and are alone. Repeated rows are copies of one another; ids must not name different texts. A row with a null
    id gets its class's component if a row with an id has the same set, else null. Other columns are not read.
    """
    docs = id_and_text(documents, key, text)
    sketch = shingle_sketch(docs, k)
    sets = document_sets(docs, k, percent, sketch).filter("n > 0")
    classes = cut_lineage(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("tokens").alias("tokens")))

    by_token = Window.partitionBy("token")
    first = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100.0) - F.lit(1e-9)).cast("int") + 1
    postings = classes.filter("rep is not null").select("rep", "n", F.posexplode(F.slice("tokens", 1, first)).alias("pos", "token"))
    several = postings.withColumn("held", F.count(F.lit(1)).over(by_token)).withColumn("lead", F.min(F.struct("pos", "n", "rep")).over(by_token)).filter("held > 1")
    shared = cut_lineage(several.select("token", "rep", "n", "pos", "lead"))

    def linkable(n: Column, m: Column, at: Column, at_m: Column) -> Column:
        """Whether a pair can link whose first common shingle has these places."""
        return _sizes_fit(n, m, percent) & (F.least(n - at, m - at_m) >= _overlap_needed(n, m, percent))

    def share_enough(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("rep").alias(x), F.col("l").alias(f"l_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in ("a", "b"))
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return cut_lineage(pairs.join(a, "a").join(b, "b").filter(common >= F.least("l_a", "l_b")).select("a", "b"))

    near_lead = linkable(F.col("n"), F.col("lead.n"), F.col("pos"), F.col("lead.pos"))
    stars = shared.filter((F.col("rep") != F.col("lead.rep")) & near_lead).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()
    stars = share_enough(stars)
    links = cut_lineage(verified(docs, stars, k, percent))
    near = cut_lineage(connected_components(links))

    labelled = shared.join(near.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.withColumn("lowest", F.min("component").over(by_token)).withColumn("highest", F.max("component").over(by_token)).filter("lowest <> highest")
    mixed = cut_lineage(mixed.withColumn("main", F.max(F.when(F.col("rep") == F.col("lead.rep"), F.col("component"))).over(by_token)).select("token", "rep", "n", "pos", "component", "main"))
    one, two = mixed.filter("component <> main").alias("x"), mixed.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
    fits = linkable(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"))
    rest = one.join(two, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & once & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    tried = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = share_enough(rest.join(tried, ["a", "b"], "left_anti"))
    more = verified(docs, rest, k, percent)

    final = connected_components(links.unionByName(more)).select(F.col("node").alias("rep"), "component")
    named = classes.select("set_key", "rep").join(final, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    members = document_sets(docs, k, percent, None)
    return members.join(named, "set_key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def one_per_group(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of `documents`, all columns as they were, with one document of each group: the one with the smallest id.

    Repeated rows of that id stay; rows with a null id stay.
    """
    drop = near_duplicates(documents, key=key, **options).filter("component_id < doc_id").select(F.col("doc_id").alias("_dropped_id")).distinct()
    return documents.join(drop, F.col(key).cast("long") == F.col("_dropped_id"), "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.to_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY ALL
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE = {"op3_jaccard_join": ORACLE_SQL}
