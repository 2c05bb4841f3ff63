"""Importance resampling towards a target: hashed word n-grams weigh documents, Gumbel noise draws them without replacement.

Words and their runs are told apart by the CRC-32 of their bytes modulo a number of buckets. An Aho-Corasick automaton
holds the distinct words, each between blanks and with its CRC and its length; one pass over a piece of text emits the
payloads of its words in order, and the CRC of a run follows from the payloads of its words alone: the CRC is linear, so
the CRC of a word is moved past the bytes that follow it and the next one is added. No string is built for a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.ranking import number_within
from panelwright.llm.words import MARKS, Words, id_and_text, scan
from panelwright.session import cut_lineage

LONGEST, BUCKETS, SEED = 3, 10_000, 42
#: A document has to have this many words to be drawn, and this share of such documents is.
LEAST_WORDS, PERCENT = 20, 5
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_BLANK = np.uint32(zlib.crc32(b" "))


# --- CRC of joined strings ------------------------------------------------------------------

def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its values for each byte."""
    return table[0, x & 255] ^ table[1, (x >> 8) & 255] ^ table[2, (x >> 16) & 255] ^ table[3, x >> 24]


def _one_byte() -> np.ndarray:
    """The map that moves a CRC past one byte."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(POLYNOMIAL), low >> 1)
    whole = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return (whole >> 8) ^ low[whole & 255]


#: Maps past 0 to 64 bytes, side by side, and past 2**k bytes.
NEAR = 64
_STEP = _one_byte()
_near = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
for _ in range(NEAR):
    _near.append(_apply(_STEP, _near[-1]))
_NEAR = np.stack(_near).ravel()
_FAR = [_STEP]
for _ in range(40):
    _FAR.append(_apply(_FAR[-1], _FAR[-1]))


def moved_past(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved past as many bytes as given for each."""
    at = np.minimum(lengths, NEAR) * 1024
    out = _NEAR[at + (crc & 255)] ^ _NEAR[at + 256 + ((crc >> 8) & 255)] ^ _NEAR[at + 512 + ((crc >> 16) & 255)] ^ _NEAR[at + 768 + (crc >> 24)]
    far = np.flatnonzero(lengths > NEAR)
    if len(far):
        x, left = crc[far], lengths[far]
        for k, table in enumerate(_FAR):
            on = (left >> k) & 1 == 1
            x[on] = _apply(table, x[on])
        out[far] = x
    return out


def joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of left, a blank, and right, whose byte lengths are given."""
    return moved_past(_apply(_STEP, left) ^ _BLANK, lengths) ^ right


# --- the dictionary -------------------------------------------------------------------------

class WordDictionary:
    """An automaton of distinct words between blanks; a word's payload is its CRC and, above 32 bits, its length.

    It grows with the words it meets and starts anew from the latest ones when it would pass its bounds, so a worker
    holds at most `most` words of `longest` bytes. Words it does not hold yet get their payload directly: what it
    remembers never changes a result.
    """

    def __init__(self, most: int = 150_000, longest: int = 48):
        self.most, self.longest, self.known, self.new, self.automaton = most, longest, {}, {}, None

    def _learn(self) -> None:
        if len(self.known) + len(self.new) > self.most:
            self.known = {}
        self.known.update(self.new)
        self.new = {}
        if not self.known:
            return
        self.automaton = ahocorasick.Automaton()
        for word, payload in self.known.items():
            self.automaton.add_word(" " + word.decode("latin-1") + " ", payload)
        self.automaton.make_automaton()

    def payloads(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(CRCs, lengths) of all words of a piece."""
        n, lengths = len(words.starts), words.ends - words.starts
        out = np.full(n, -1, np.int64)
        if self.automaton is not None and n:
            blanks = np.cumsum(lengths + 1)
            line = np.full(int(blanks[-1]) + 1, 32, np.uint8)
            letters = np.ones(len(line), bool)
            letters[0] = letters[blanks] = False
            line[letters] = words.data[~MARKS[words.data]]
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(line.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
            out[np.searchsorted(blanks, emitted[:, 0])] = emitted[:, 1]
        for i in np.flatnonzero(out < 0).tolist():
            word = words.get(i)
            payload = self.new.get(word) or self.known.get(word)
            if payload is None:
                payload = zlib.crc32(word) | len(word) << 32
                if len(word) <= self.longest:
                    self.new[word] = payload
                    if len(self.new) >= max(min(4096, self.most), min(len(self.known), self.most // 2)):
                        self._learn()
            out[i] = payload
        return (out & 0xFFFFFFFF).astype(np.uint32), out >> 32


_dictionary: list[WordDictionary] = []


def dictionary() -> WordDictionary:
    """One dictionary per worker process, shared by the tasks it runs."""
    if not _dictionary:
        _dictionary.append(WordDictionary())
    return _dictionary[0]


def run_buckets(words: Words, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length 1 to `longest`: (first words, buckets) of all runs of so many words within one text."""
    crc, lengths = dictionary().payloads(words)
    n, acc = len(crc), crc
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))
    for k in range(1, min(longest, n) + 1):
        if k > 1:
            acc = joined(acc[: n - k + 1], crc[k - 1 :], lengths[k - 1 :])
        at = np.flatnonzero(np.arange(n - k + 1) + k <= last[: n - k + 1])
        yield at, (acc[at] % np.uint32(buckets)).astype(np.int64)


# --- counting, scoring, drawing -------------------------------------------------------------

def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many runs of all texts fall in each bucket; buckets without any are absent.

    A task adds up all its texts before the shuffle, so it sends at most one row a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in scan(batch.column("text"), MARKS, hashed=False):
                for _, found in run_buckets(words, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: the floored thousandfold log ratio of the smoothed shares in target and raw."""
    sides = bucket_counts(raw, buckets=buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.unionByName(bucket_counts(target, buckets=buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = cut_lineage(sides.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = counts.select(F.struct(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))).scalar()
    up = (F.col("t") + F.lit(1.0)) * (F.col("w.s") + F.lit(float(buckets)))
    down = (F.col("s") + F.lit(1.0)) * (F.col("w.t") + F.lit(float(buckets)))
    return counts.withColumn("w", whole).select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("long").alias("gain"))


SCHEMA = "doc_id long, n_words long, n_features long, weight long"


def weigh(documents: DataFrame, gains: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains over all runs of each whole text. `gains` has one row a bucket."""
    table = np.zeros(buckets)
    for r in gains.collect():
        table[r["bucket"]] = r["gain"]
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for words in scan(batch.column("text"), MARKS, hashed=False):
                owner, n = words.text_of(), words.texts
                features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for at, found in run_buckets(words, buckets, longest):
                    features += np.bincount(owner[at], minlength=n)
                    weight += np.bincount(owner[at], gain[found], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(words.first, n), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(features), pa.array(weight),
                ], names=["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(documents, key, text).mapInArrow(run, SCHEMA)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandfold standard Gumbel noise of an id, rounded down; a null id counts as an empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """One row per row of `documents`: doc_id, n_words, n_features, weight, score, and rank if it is drawn.

    Documents with `least_words` words or more are drawn, `percent` of them, by the highest scores; ties go to the
    smaller id (null first), then to the smaller weight and count. A null or empty text has no words, no features and
    weight 0; repeated rows are drawn one by one; an empty target or empty documents give gains of the smoothing alone.
    No other column is read. A very long text is one piece of its own. Texts are read twice and never shuffled: what
    moves is one row a bucket and task, and one narrow row a document, which is ordered over many tasks.
    """
    gains = bucket_gains(documents, target, buckets)
    scored = cut_lineage(weigh(documents, gains, buckets=buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    drawn = scored.select(F.floor(F.count(F.when(able, 1)) * F.lit(percent) / F.lit(100)).cast("long")).scalar()
    order = [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col("doc_id"), F.col("weight"), F.col("n_features")]
    placed = number_within(scored, [], order, "place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def op11_importance_sample(spark, sf_dir: str) -> DataFrame:
    rows = importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def _oracle() -> str:
    def words(table: str) -> str:
        return f"SELECT row_number() OVER () AS r, {'doc_id' if table == 'documents' else 'item_id'} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"

    def runs(table: str) -> str:
        return " UNION ALL ".join(f"SELECT r, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS f FROM {table}" for k in range(1, LONGEST + 1))

    return f"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}) ELSE c // 2 END)) AS t),
d AS MATERIALIZED ({words("documents")}), b AS MATERIALIZED ({words("benchmark")}), df AS MATERIALIZED ({runs("d")}), bf AS MATERIALIZED ({runs("b")}),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % {BUCKETS} AS k
  FROM (SELECT DISTINCT f FROM df UNION SELECT DISTINCT f FROM bf), steps),
s AS (SELECT k, count(*) AS n FROM df JOIN crc USING (f) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY k),
w AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s, (SELECT count(*) FROM bf)::DOUBLE AS t),
g AS (SELECT x.k, floor(1000::DOUBLE * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (w.s + {BUCKETS})) / ((coalesce(s.n, 0) + 1)::DOUBLE * (w.t + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) x(k) LEFT JOIN s ON s.k = x.k LEFT JOIN t ON t.k = x.k, w),
v AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM df JOIN crc USING (f) JOIN g USING (k) GROUP BY r),
h AS (SELECT d.id AS doc_id, len(w) AS n_words, coalesce(v.n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substring(sha256('{SEED}:' || d.id), 1, 8))::BIGINT AS h FROM d LEFT JOIN v ON v.r = d.r),
o AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (n_words < {LEAST_WORDS})::INT, score DESC, doc_id) AS p FROM o)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN p <= {PERCENT} * (SELECT count(*) FROM o WHERE n_words >= {LEAST_WORDS}) // 100 THEN p END::BIGINT AS rank FROM p
"""


QUERIES = {"op11_importance_sample": op11_importance_sample}
ORACLE = {"op11_importance_sample": _oracle()}
