"""Language-model scoring: interpolated modified Kneser-Ney bigrams, counted in Spark, kept as sorted mapped arrays.

The model is a folder of plain arrays in the shared folder, in parts whose number follows the bytes of the texts (and is
at least the session's shuffle partitions), so a part stays of one size and one task at any size of the corpus:

* words: sorted 64-bit hashes, dealt by hash range, with their training counts and their continuation counts. A word's
  number is its place in the whole sorted sequence.
* bigrams: sorted 64-bit keys (context number, word number) with their counts, dealt by a hash of the context. A context
  with more than a fair share of all tokens is dealt by context and word, so no part outgrows the others.
* contexts: sorted numbers with the sums that the discounts need, tokens in 64 bits. Those of dealt-out contexts (at most a few per part) are
  added up by Spark and travel with the model's constants.

Tasks pre-aggregate tokens, and Spark shuffles packed, sorted, compressed runs of (key, count); a reducing task merges
the runs of one part. Files are written under a temporary name and renamed, so a repeated task does no harm. Workers map
a bounded number of arrays at a time and look up sorted unique keys; nothing of the model's size is in a heap, and the
driver sees a row per part. Word numbers have 32 bits: a corpus of 4.29 billion distinct words or more is refused.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.words import SPACES, id_and_text, mix, scan
from panelwright.session import cut_lineage, ensure_checkpoint_dir

#: Hash of the end token (no word has it but by a 64-bit collision) and tokens that a task aggregates at once.
END = np.uint64(0x5BF0_3635_D9A1_7C4E)
RUN_TOKENS = 2_000_000
SCORE_TOKENS = 500_000
#: Bytes of text per part of the model, and files that a worker maps at once (each holds a file descriptor).
PART_BYTES = 128 << 20
MAPPED = 384
PACKED = "part int, keys binary, counts binary"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_hashes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, bounds, hashes) of about `most` tokens at a time; every document closes with END."""
    for batch in batches:
        ids, first, held, tokens = batch.column("doc_id"), 0, [], 0

        def flush(stop: int):
            nonlocal first, held, tokens
            sizes = np.concatenate([np.diff(w.bounds) for w in held]) + 1
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            out = np.full(bounds[-1], END, np.uint64)
            inside = np.ones(bounds[-1], bool)
            inside[bounds[1:] - 1] = False
            out[inside] = np.concatenate([w.hashes for w in held])
            done = (ids.slice(first, stop - first), bounds, out)
            first, held, tokens = stop, [], 0
            return done

        for words in scan(batch.column("text"), SPACES):
            held.append(words)
            tokens += len(words.hashes)
            if tokens >= most:
                yield flush(words.first + words.texts)
        if held:
            yield flush(batch.num_rows)


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as byte planes of their gaps, and counts, both compressed."""
    squeeze = zstandard.ZstdCompressor(1)
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeeze.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes()), squeeze.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    gaps, n = (np.ascontiguousarray(np.frombuffer(expand.decompress(x), np.uint8).reshape(8, -1).T).view("<u8").ravel() for x in (keys, counts))
    return np.cumsum(gaps, dtype=np.uint64), n


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some runs with the sums of their counts."""
    if not runs:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    keys, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[cut], np.add.reduceat(counts[order], cut) if len(cut) else counts[:0]


def packed_rows(part_of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """One packed run per part."""
    order = np.lexsort((keys, part_of))
    part_of, keys, counts = part_of[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], part_of[1:] != part_of[:-1]])) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(part_of[a]), *pack(keys[a:b], counts[a:b])


def _batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])


def merged_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts) of rows that come sorted by part."""
    at, runs, size = None, [], 0
    for batch in batches:
        for part, keys, counts in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            if part != at and at is not None:
                yield at, *merge(runs)
                runs, size = [], 0
            at = part
            runs.append(unpack(keys, counts))
            size += len(runs[-1][0])
            if len(runs) > 1 and size > 1 << 21:  # keep what is held near the distinct keys
                runs = [merge(runs)]
                size = len(runs[0][0]) // 2
    if at is not None:
        yield at, *merge(runs)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder as a path that workers can map. Mapping needs a mounted file system."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    path = root.removeprefix("file:") if root.startswith("file:") else root
    if not path.startswith("/"):
        raise ValueError(f"the model's arrays are memory-mapped: spark.checkpoint.dir must be a mounted shared folder, not {root}")
    return f"/{path.lstrip('/')}/{name}/{uuid.uuid4().hex}"


def save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{folder}/{name}")


def load(folder: str, name: str, kind) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)


class Mapped:
    """Arrays of a folder by name; the least recently used is let go when more than `most` are mapped."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.open = folder, most, OrderedDict()

    def __call__(self, name: str, kind) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = load(self.folder, name, kind)
            if len(self.open) > self.most:
                self.open.popitem(last=False)
        return self.open[name]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of entries with counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 1.0  # too little data for the estimate
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


@dataclass
class Constants:
    """What every worker needs besides the arrays: sizes per part, discounts, and dealt-out contexts."""

    folder: str
    parts: int
    sizes: list[int]
    tokens: int
    hot: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    d1: tuple[float, float, float] = (0.5, 0.75, 1.0)
    d2: tuple[float, float, float] = (0.5, 0.75, 1.0)
    continuations: tuple[int, int, int, int] = (0, 0, 0, 0)
    mapped: int = MAPPED

    @property
    def firsts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes)


def word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def bigram_part(contexts: np.ndarray, words: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    place = np.minimum(np.searchsorted(hot, contexts), max(len(hot) - 1, 0))
    spread = (hot[place] == contexts) if len(hot) else np.zeros(len(contexts), bool)
    return (mix(contexts + np.uint64(1) + np.where(spread, mix(words + np.uint64(7)), np.uint64(0))) % np.uint64(parts)).astype(np.int64)


class Arrays:
    """Mapped arrays of a model."""

    def __init__(self, c: Constants):
        self.c, self.mapped = c, Mapped(c.folder, c.mapped)
        self.firsts, self.hot = c.firsts, np.array(sorted(c.hot), np.uint64)
        self.hot_sums = np.array([c.hot[int(h)] for h in self.hot], np.float64).reshape(-1, 4)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(word_part(hashes, self.c.parts), np.arange(self.c.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b, known = cuts[p], cuts[p + 1], self.mapped(f"words.{p}", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + self.firsts[p], -1)
        return out

    def of_words(self, name: str, kind, numbers: np.ndarray) -> np.ndarray:
        """Values that the arrays of this name have at sorted word numbers."""
        out = np.zeros(len(numbers), np.float64)
        cuts = np.searchsorted(numbers, self.firsts)
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            out[cuts[p] : cuts[p + 1]] = self.mapped(f"{name}.{p}", kind)[numbers[cuts[p] : cuts[p + 1]] - self.firsts[p]]
        return out

    def bigrams(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums of the context) of distinct bigrams of known words."""
        counts, sums = np.zeros(len(words)), np.zeros((len(words), 4))
        keys = (contexts << np.uint64(32)) | words
        parts = bigram_part(contexts, words, self.hot, self.c.parts)
        order = np.lexsort((keys, parts))
        cuts = np.searchsorted(parts[order], np.arange(self.c.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[p] : cuts[p + 1]]
            known, owners = self.mapped(f"bigrams.{p}", np.uint64), self.mapped(f"contexts.{p}", np.uint64)
            if len(known):
                seen = self.mapped(f"seen.{p}", np.uint8)
                at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
                n = np.where(known[at] == keys[rows], seen[at], 0).astype(np.float64)
                many = np.flatnonzero(n == 255)
                if len(many):
                    often = self.mapped(f"often.{p}", np.uint64).reshape(-1, 2)
                    n[many] = often[np.searchsorted(often[:, 0], at[many].astype(np.uint64)), 1]
                counts[rows] = n
            if len(owners):
                at = np.minimum(np.searchsorted(owners, contexts[rows]), len(owners) - 1)
                found = owners[at] == contexts[rows]
                sums[rows, 0] = np.where(found, self.mapped(f"totals.{p}", np.uint64)[at], 0)
                sums[rows, 1:] = np.where(found[:, None], self.mapped(f"kinds.{p}", np.uint32).reshape(-1, 3)[at], 0)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
            is_hot = self.hot[at] == contexts
            sums[is_hot] = self.hot_sums[at[is_hot]]
        return counts, sums


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes in token_hashes(batches, RUN_TOKENS):
            keys, counts = np.unique(hashes, return_counts=True)
            yield _batch(list(packed_rows(word_part(keys, parts), keys, counts)))

    return run


def _contexts_of(bounds: np.ndarray, numbers: np.ndarray, start: int) -> np.ndarray:
    """Number of the token before each; `start` before a document's first."""
    before = np.concatenate([[start], numbers[:-1]])
    before[bounds[:-1]] = start
    return before


def _count_bigrams(c: Constants):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, hot = Arrays(c), np.array(sorted(c.hot), np.uint64)
        for _, bounds, hashes in token_hashes(batches, RUN_TOKENS):
            keys, back = np.unique(hashes, return_inverse=True)
            numbers = arrays.numbers(keys)[back]
            pairs, counts = np.unique((_contexts_of(bounds, numbers, c.vocabulary).astype(np.uint64) << np.uint64(32)) | numbers.astype(np.uint64), return_counts=True)
            yield _batch(list(packed_rows(bigram_part(pairs >> np.uint64(32), pairs & np.uint64(2**32 - 1), hot, c.parts), pairs, counts)))

    return run


def _write_bigrams(c: Constants):
    """Writes a part's arrays; gives rows of continuation runs (kind 0), sums of dealt-out contexts (1) and counts of counts (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, firsts = np.array(sorted(c.hot), np.uint64), c.firsts
        for part, keys, counts in merged_parts(batches):
            save(c.folder, f"bigrams.{part}", keys)
            save(c.folder, f"seen.{part}", np.minimum(counts, 255).astype(np.uint8))
            many = np.flatnonzero(counts >= 255).astype(np.uint64)
            save(c.folder, f"often.{part}", np.stack([many, counts[many.astype(np.int64)]], axis=1))
            contexts = keys >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
            sums = np.stack([np.add.reduceat(x.astype(np.int64), cut) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
            owners = contexts[cut]
            dealt = np.isin(owners, hot)
            save(c.folder, f"contexts.{part}", owners[~dealt])
            save(c.folder, f"totals.{part}", sums[~dealt, 0].astype(np.uint64))
            save(c.folder, f"kinds.{part}", sums[~dealt, 1:].astype(np.uint32))  # numbers of distinct words
            words, n = np.unique(keys & np.uint64(2**32 - 1), return_counts=True)
            rows = [(0, *r) for r in packed_rows(np.searchsorted(firsts, words.astype(np.int64), "right") - 1, words, n)]
            rows += [(1, 0, np.array([o], np.uint64).tobytes(), s.tobytes()) for o, s in zip(owners[dealt], sums[dealt])]
            rows.append((2, 0, b"", np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *_batch([r[1:] for r in rows]).columns], names=["kind", "part", "keys", "counts"])

    return run


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> Constants:
    """Model of the given documents; an empty table gives a model that knows no word.

    Null and empty texts are the end token alone; very long texts are read in stretches; repeated rows and ids count
    again. One pass adds up the texts' bytes, of which a part gets `part_bytes`, and two count words and bigrams.
    """
    spark = documents.sparkSession
    docs = id_and_text(documents, key, text)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    folder = shared_folder(spark, "lm")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part")  # one part, one task

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in merged_parts(batches):
            save(folder, f"words.{part}", keys)
            save(folder, f"counts.{part}", counts)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["part", "words", "tokens"])

    found = dealt(docs.mapInArrow(_count_words(parts), PACKED)).mapInArrow(write_words, "part int, words long, tokens long").collect()  # a row per part
    sizes = [0] * parts
    for r in found:
        sizes[r["part"]] = r["words"]
    c = Constants(folder, parts, sizes, sum(r["tokens"] for r in found))
    if c.vocabulary >= 2**32 - 1:
        raise ValueError("word numbers have 32 bits")

    share, firsts = c.tokens / (4 * parts), c.firsts

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("id").to_pylist():
                at = np.flatnonzero(load(folder, f"counts.{p}", np.uint64) > share)
                yield pa.RecordBatch.from_arrays([pa.array(at + firsts[p], pa.int64())], names=["number"])

    hot = [r["number"] for r in spark.range(0, parts, 1, min(parts, 64)).mapInArrow(frequent, "number long").collect()]  # fewer than 4 * parts
    c.hot = dict.fromkeys([*hot, c.vocabulary], (0, 0, 0, 0))  # documents' starts count as frequent too

    written = cut_lineage(dealt(docs.mapInArrow(_count_bigrams(c), PACKED)).mapInArrow(_write_bigrams(c), f"kind int, {PACKED}"))
    n = np.zeros(4, np.int64)
    for r in written.filter("kind = 2").select("counts").collect():  # a row per part
        n += np.frombuffer(r["counts"], np.int64)
    c.d2 = discounts(n.tolist())
    for owner, sums in ((int(np.frombuffer(r["keys"], np.uint64)[0]), np.frombuffer(r["counts"], np.int64)) for r in written.filter("kind = 1").select("keys", "counts").toLocalIterator()):
        c.hot[owner] = tuple(int(a + b) for a, b in zip(c.hot[owner], sums))

    def write_continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, counts in merged_parts(batches):
            dense = np.zeros(sizes[part], np.uint32)
            dense[words.astype(np.int64) - firsts[part]] = counts
            save(folder, f"continued.{part}", dense)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (dense.sum(dtype=np.int64), *((dense == k).sum() for k in (1, 2, 3, 4)))], names=["total", "n1", "n2", "n3", "n4"])

    sums = dealt(written.filter("kind = 0").select("part", "keys", "counts")).mapInArrow(write_continued, "total long, n1 long, n2 long, n3 long, n4 long")
    t = sums.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("total", "n1", "n2", "n3", "n4"))).first()
    c.d1 = discounts([t["n1"], t["n2"], t["n3"], t["n4"]])
    c.continuations = (t["total"], t["n1"], t["n2"], c.vocabulary - t["n1"] - t["n2"])
    return c


SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts <= 0, 0.0, np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])))


def score(documents: DataFrame, c: Constants, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text, in log10.

    Null and empty texts are the end token alone; ids may be null or repeated; other columns are not read. Unknown words
    share the mass of one word more than the vocabulary has. A map over the scan without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(c)
        total, m1, m2, m3 = c.continuations
        spare = (c.d1[0] * m1 + c.d1[1] * m2 + c.d1[2] * m3) / total if total else 1.0
        for ids, bounds, hashes in token_hashes(batches, SCORE_TOKENS):
            keys, back = np.unique(hashes, return_inverse=True)
            numbers = arrays.numbers(keys)
            known = numbers >= 0
            count, low = np.zeros(len(keys)), np.full(len(keys), spare / (c.vocabulary + 1))
            count[known] = arrays.of_words("counts", np.uint64, numbers[known])
            continued = arrays.of_words("continued", np.uint32, numbers[known])
            low[known] += (continued - _discount(continued, c.d1)) / max(total, 1)
            base = np.log10((count + 1) / (c.tokens + c.vocabulary + 1))
            of, p = numbers[back], low[back]
            before = _contexts_of(bounds, of, c.vocabulary)
            at = np.flatnonzero(before >= 0)
            # an unknown word takes the number after the start's: its bigram is never found, its context's sums are
            pairs, again = np.unique((before[at].astype(np.uint64) << np.uint64(32)) | np.where(of[at] >= 0, of[at], c.vocabulary + 1).astype(np.uint64), return_inverse=True)
            n, sums = arrays.bigrams(pairs >> np.uint64(32), pairs & np.uint64(2**32 - 1))
            whole = np.maximum(sums[:, 0], 1.0)
            direct = (n - _discount(n, c.d2)) / whole
            weight = np.where(sums[:, 0] > 0, (sums[:, 1:] @ np.array(c.d2)) / whole, 1.0)
            p[at] = direct[again] + weight[again] * p[at]

            def per_document(x: np.ndarray) -> np.ndarray:
                return np.add.reduceat(x, bounds[:-1])

            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds).astype(np.int64)), pa.array(per_document((count[back] > 0).astype(np.int64))), pa.array(per_document(base[back])), pa.array(per_document(np.log10(p)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return id_and_text(documents, key, text).mapInArrow(run, SCORE_SCHEMA)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents.filter(~held_out()))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op8_kneser_ney": op8_kneser_ney}
ORACLE: dict[str, str] = {}
