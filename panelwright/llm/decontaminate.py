"""Benchmark decontamination: a broadcast set of normalised test windows against the word windows of every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import MARKS, Words, id_and_text, mix, scan, spans_to_mask
from panelwright.session import cut_lineage

WIDTH = 13
#: Windows a worker holds at most. Those of a larger benchmark stay a table, which the documents' windows join.
MAX_WINDOWS = 200_000


def _windows(words: Words, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, first word, length, hash) of the windows of every text of a piece."""
    at, hashes = words.runs(width)
    owner = words.text_of()
    yield from zip(owner[at].tolist(), at.tolist(), [width] * len(at), hashes.tolist())
    for t in np.flatnonzero((np.diff(words.bounds) > 0) & (np.diff(words.bounds) < width)).tolist():
        a, b = int(words.bounds[t]), int(words.bounds[t + 1])
        part = Words(0, words.data, words.starts[a:b], words.ends[a:b], np.array([0, b - a]), words.hashes[a:b])
        yield t, a, b - a, int(part.runs(b - a)[1][0])


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, hash, window): the distinct windows of every item, `window` being its words joined by blanks.

    Items without words, with a null text or a null id have no windows; a repeated item counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("doc_id").to_pylist()
            for words in scan(batch.column("text"), MARKS):
                rows = [(items[words.first + t], k, h, b" ".join(words.get(i) for i in range(a, a + k)).decode("utf-8", "replace")) for t, a, k, h in _windows(words, width)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64)), pa.array([r[3] for r in rows], pa.string()),
                ], names=["item", "length", "hash", "window"])

    items = id_and_text(benchmark, key, text).filter("doc_id is not null")
    return items.mapInArrow(run, "item long, length int, hash long, window string").distinct()


_SPAN = "struct<first_word:long, n_words:long>"
HIT_SCHEMA = f"doc_id long, n_words long, spans array<{_SPAN}>, items array<long>"


def _scan_broadcast(documents: DataFrame, windows: list) -> DataFrame:
    """Hits in every document of windows that each worker holds."""
    known: dict[int, dict[int, list[tuple[str, int]]]] = {}
    for r in windows:
        known.setdefault(r["length"], {}).setdefault(r["hash"] & (2**64 - 1), []).append((r["window"], r["item"]))
    shared = documents.sparkSession.sparkContext.broadcast([(k, np.array(sorted(v), np.uint64), v) for k, v in sorted(known.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        for batch in batches:
            for words in scan(batch.column("text"), MARKS):
                spans: list[list] = [[] for _ in range(words.texts)]
                items: list[set] = [set() for _ in range(words.texts)]
                owner = words.text_of()
                for length, hashes, table in sets:
                    at, found = words.runs(length)
                    place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    for i in at[hashes[place] == found].tolist() if len(found) else ():
                        window = b" ".join(words.get(j) for j in range(i, i + length)).decode("utf-8", "replace")
                        same = [item for w, item in table[int(found[np.searchsorted(at, i)])] if w == window]
                        if same:  # the words agree, not only their hashes
                            t = int(owner[i])
                            spans[t].append({"first_word": i - int(words.bounds[t]), "n_words": length})
                            items[t].update(same)
                kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(words.first, words.texts), pa.array(np.diff(words.bounds).astype(np.int64)),
                    pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ], names=["doc_id", "n_words", "spans", "items"])

    return documents.mapInArrow(run, HIT_SCHEMA)


#: Bits of the filter in each row that reaches the driver, and the logarithm of the filter's most bits (128 MB).
SLICE, MOST_BITS = 1 << 20, 30
#: Bits that each window sets, and bits of the filter for each window: some 2 of 10,000 other windows pass.
PROBES, BITS_EACH = 4, 32


def _place(hashes: np.ndarray, probe: int, size: int) -> np.ndarray:
    """Bit of each hash in a filter of `size` bits, a power of two."""
    return mix(hashes + np.uint64(probe + 1) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(size - 1)


def _window_filter(windows: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of `n` windows, set by tasks a slice at a time; the driver joins the slices."""
    size = 1 << min(max((BITS_EACH * n - 1).bit_length(), SLICE.bit_length() - 1), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            at = np.concatenate([_place(hashes, k, size) for k in range(PROBES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SLICE), pa.array((at % SLICE).astype(np.int32))], names=["slice", "bit"])

    def bits(table: pa.Table) -> pa.Table:
        on = np.zeros(SLICE, bool)
        on[table.column("bit").to_numpy()] = True
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    slices = windows.select("hash").mapInArrow(places, "slice long, bit int").groupBy("slice").applyInArrow(bits, "slice long, bits binary")
    for r in slices.toLocalIterator():
        out[r["slice"] * (SLICE // 8) : (r["slice"] + 1) * (SLICE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _scan_joined(documents: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """Hits in every document of windows of any number: a filter picks the documents' windows, which join the table.

    Rows are told apart by a number that is written with what was picked, so null and repeated ids stay rows of their own.
    """
    shared = documents.sparkSession.sparkContext.broadcast((_window_filter(windows, n), sorted(r["length"] for r in windows.select("length").distinct().collect())))
    kind = pa.list_(pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("window", pa.string()), ("first_words", pa.list_(pa.int64()))]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, lengths = shared.value
        for batch in batches:
            for words in scan(batch.column("text"), MARKS):
                picked: list[dict] = [{} for _ in range(words.texts)]
                owner = words.text_of()
                for length in lengths:
                    at, found = words.runs(length)
                    for k in range(PROBES):
                        bit = _place(found, k, 8 * len(on))
                        keep = (on[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0
                        at, found = at[keep], found[keep]
                    for i, h in zip(at.tolist(), found.view(np.int64).tolist()):
                        window = b" ".join(words.get(j) for j in range(i, i + length)).decode("utf-8", "replace")
                        t = int(owner[i])
                        picked[t].setdefault((length, h, window), []).append(i - int(words.bounds[t]))
                rows = [[{"length": k, "hash": h, "window": w, "first_words": x} for (k, h, w), x in p.items()] for p in picked]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(words.first, words.texts) for c in ("row", "doc_id")), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(rows, kind),
                ], names=["row", "doc_id", "n_words", "picked"])

    schema = "row long, doc_id long, n_words long, picked array<struct<length:int, hash:long, window:string, first_words:array<long>>>"
    scanned = cut_lineage(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(pick, schema))
    known = windows.groupBy("length", "hash", "window").agg(F.collect_list("item").alias("items"))
    hits = scanned.select("row", F.inline("picked")).join(known, ["length", "hash", "window"])  # the words agree, not only their hashes
    spans = F.transform("first_words", lambda a: F.struct(a.alias("first_word"), F.col("length").cast("long").alias("n_words")))
    found = hits.select("row", spans.alias("spans"), "items").groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return scanned.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items")
    )


REPORT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<first_word:long, n_words:long>>"


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", max_windows: int = MAX_WINDOWS, share: int = 20) -> DataFrame:
    """One row per document: words, hit words, items found, and whether at least one word in `share` is hit.

    Words are compared folded to lower case and without punctuation. A window hit by its hash is compared word by word.
    The benchmark's windows are counted first: up to `max_windows` are broadcast; more are written once and joined with
    what a filter of their hashes picks from the documents, so that only the filter passes the driver. Both give the same rows.
    Null and empty texts have no words, no hits and are clean; an empty benchmark leaves every document clean; other
    columns of either table are not read; rows with repeated or null ids stay rows of their own.
    """
    windows = benchmark_windows(benchmark, width)
    docs = id_and_text(documents, key, text)
    n = windows.count()
    hits = _scan_broadcast(docs, windows.collect()) if n <= max_windows else _scan_joined(docs, cut_lineage(windows), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n_words").to_pylist()
            n_hit, digest, merged, n_items = [], [], [], []
            for n, spans, items in zip(counts, batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                mask = spans_to_mask(np.array([s["first_word"] for s in spans], np.int64), np.array([s["n_words"] for s in spans], np.int64), n) if spans else np.zeros(0, bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                merged.append([{"first_word": int(a), "n_words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
                n_hit.append(int(mask.sum()))
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
            bad = [h > 0 and share * h >= n for h, n in zip(n_hit, counts)]
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(merged, kind),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    return hits.mapInArrow(run, REPORT_SCHEMA)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of `documents`, all columns as they were, without those of contaminated documents.

    Rows whose id is null cannot be told apart and are kept.
    """
    bad = contamination(documents, benchmark, key=key, **options).filter("contaminated and doc_id is not null").select(F.col("doc_id").alias("_contaminated_id")).distinct()
    return documents.join(bad, F.col(key).cast("long") == F.col("_contaminated_id"), "left_anti")


def cut_spans(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans; the characters between kept words stay."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8")
    (words,) = list(scan(pa.array([text]), MARKS, hashed=False)) or [None]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : words.starts[s["first_word"]]])
        at = int(words.ends[s["first_word"] + s["n_words"] - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8")


def remove_spans(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, text) with every hit span cut out of the text. Ids must be unique, as spans are joined by id."""
    docs = id_and_text(documents, key, text)
    spans = contamination(documents, benchmark, key=key, text=text, **options).filter("n_hit > 0").select("doc_id", "hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [cut_spans(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("hit_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(new, pa.string())], names=["doc_id", "text"])

    return docs.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, text string")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hit_spans")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(len(w) - least(len(w), 13) + 1)) AS i FROM bw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM dw, (SELECT DISTINCT k FROM win)),
hit AS (SELECT p.doc_id, p.k, p.i, v.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM pos) p JOIN win v ON v.k = p.k AND v.g = p.g),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN cover c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE = {"op9_decontaminate": ORACLE_SQL}
