"""Toxicity: a weighted lexicon, learned from labels, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters and turns punctuation into blanks, so
`1d10t` and a Cyrillic look-alike read `idiot`. Lexicon entries are whole words or stems (word beginnings). A match inside
an exception phrase does not count. The matched weight and the weight per hundred words go through a logistic curve.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.words import SPACES, id_and_text, scan
from panelwright.session import cut_lineage

#: Most labelled rows that the lexicon and the curve are fitted on: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Shares of a group of copies add up to this: a multiple of 1 to 16, so that sums stay integers.
WHOLE = 720_720
STEMS = (4, 5, 6, 7)

#: Look-alikes and digit substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}
#: Words with a weight from the start, and phrases in which they are harmless.
SEEDS = "idiot idiots moron morons imbecile stupid dumbass pathetic worthless disgusting loser losers scum scumbag trash vermin filth clown bastard asshole bitch".split()
SEED_WEIGHT = 3.0
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bag", "trash bags", "clown fish", "circus clown", "pond scum", "soap scum", "not stupid"]

_SOFT = "!|"  # letters only inside a word
_TABLE = {ord(c): " " for c in map(chr, range(128)) if not c.isalnum()} | {ord(a): b for a, b in HOMOGLYPHS.items() if a not in _SOFT}
_TABLE |= {c: " " for c in (*range(0x80, 0xA0), 0xA0, 0xAB, 0xBB, 0xBF, 0xA1, *range(0x2000, 0x2070), 0x3000)}
_TABLE |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF)}


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    text = (text or "").lower()
    for c in _SOFT:
        if c in text:
            text = "".join(HOMOGLYPHS[c] if x == c and 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum() else x for i, x in enumerate(text))
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Model:
    """Lexicon entry -> weight ("word" or "stem*"), exception phrases, and the curve's coefficients."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = tuple(EXCEPTIONS)
    curve: tuple[float, float, float] = (-2.0, 2.0, 0.5)


class Matcher:
    """Matched weight of texts under a model."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        values: dict[str, tuple[float, bool]] = {}
        for entry, weight in model.entries.items():
            stem = entry.endswith("*")
            folded = " ".join(fold(entry.rstrip("*")))
            if folded:
                values[f" {folded}" + " " * (not stem)] = (weight, False)
        for phrase in model.exceptions:
            values[f" {' '.join(fold(phrase))} "] = (0.0, True)
        for pattern, (weight, exempt) in values.items():
            self.automaton.add_word(pattern, (len(pattern), weight, exempt))
        if values:
            self.automaton.make_automaton()

    def weight(self, text: str | None) -> tuple[int, int, float]:
        """(words, matched words, their weight): a word counts once, with its heaviest entry, unless an exception covers it."""
        words = fold(text)
        if not words or not len(self.automaton):
            return len(words), 0, 0.0
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (length, weight, exempt) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - length + 1
            if exempt:
                free.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        free.sort()
        starts, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))  # furthest end of the spans so far

        def exempted(at: int) -> bool:
            i = bisect_right(starts, at)
            return i > 0 and at < reach[i - 1]

        kept = [w for at, w in best.items() if not exempted(at)]
        return len(words), len(kept), float(sum(kept))


def _features(weight, words) -> np.ndarray:
    weight, words = np.asarray(weight, float), np.asarray(words, float)
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(100.0 * weight / np.maximum(words, 1.0))], axis=1)


def _fit_curve(weight, words, toxic, share) -> tuple[float, float, float]:
    """Ridge-penalised logistic regression by Newton steps, rows weighted by `share`; the documents are a bounded sample."""
    x, y, beta, c = _features(weight, words), np.asarray(toxic, float), np.zeros(3), np.asarray(share, float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (c * (y - p)) - 1e-2 * beta
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def held_out(doc_id: str | Column) -> Column:
    """Rows that no label is learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, copy_key, share) of at most `sample` labelled ids outside the held-out fold, one row each.

    Copies would make their rare words look telling, so documents of one label with the same smallest word triple share
    the weight of one document: `share` is `WHOLE` divided by their number. No text and no label is left out; of several
    rows of an id the smallest text counts, and the label toxic if any row says so.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for words in scan(batch.column("text"), SPACES):
                at, hashes = words.runs(3)
                low = np.full(words.texts, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(low, words.text_of()[at], hashes)
                short = np.flatnonzero(np.diff(words.bounds) < 3)
                low[short] = [xxhash.xxh64_intdigest(words.data[words.starts[words.bounds[t]] : words.ends[words.bounds[t + 1] - 1]].tobytes()) if words.bounds[t] < words.bounds[t + 1] else 0 for t in short]
                keys[words.first : words.first + words.texts] = low
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(keys.view(np.int64))], names=["doc_id", "toxic", "copy_key"])

    rows = cut_lineage(id_and_text(documents).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    alike = Window.partitionBy("copy_key", F.col("toxic") > 0)  # at most `sample` rows of three numbers
    share = F.round(F.lit(WHOLE) / F.count(F.lit(1)).over(alike)).cast("long")
    shares = rows.mapInArrow(run, "doc_id long, toxic int, copy_key long").select("doc_id", "copy_key", share.alias("share"))
    return rows.join(F.broadcast(shares), "doc_id").select("doc_id", "text", "toxic", "copy_key", "share")


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic, share in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "share"))):
            words = set(fold(text))
            stems = {w[:k] + "*" for k in STEMS for w in words if len(w) > k}
            seen[toxic > 0].update(dict.fromkeys(words | stems, share))
        entries = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array([seen[1][e] for e in entries], pa.int64()), pa.array([seen[0][e] for e in entries], pa.int64())], names=["entry", "toxic", "clean"])


def _lexicon(rows: DataFrame, max_entries: int | None) -> dict[str, float]:
    """Seeds, and the entries that labelled rows single out, with their weights."""
    entries = dict.fromkeys(SEEDS, SEED_WEIGHT)
    total = rows.agg(*(F.coalesce(F.sum(F.when(c, F.col("share"))), F.lit(0)).alias(n) for n, c in (("t", F.col("toxic") > 0), ("n", F.lit(True))))).first()
    t, n = total["t"] / WHOLE, total["n"] / WHOLE
    if not 0 < t < n:
        return entries
    whole = F.lit(float(WHOLE))
    counts = rows.mapInArrow(_count_entries, "entry string, toxic long, clean long").groupBy("entry").agg((F.sum("toxic") / whole).alias("t"), (F.sum("clean") / whole).alias("c")).filter("t + c >= 3").persist()
    tried, base, p = counts.count(), t / n, F.col("t") / (F.col("t") + F.col("c"))
    divergence = p * F.log(p / base) + F.when(F.col("c") > 0, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (t + 1.0)) - F.log((F.col("c") + 0.5) / (n - t + 1.0))
    telling = counts.filter("t > 0").filter(p >= max(0.7, base)).filter((F.col("t") + F.col("c")) * divergence >= float(np.log(max(tried, 2)) + 2.0))
    found = telling.select("entry", odds.alias("w"), "t").orderBy(F.desc("t"), "entry")
    found = (found if max_entries is None else found.limit(max_entries)).collect()  # words that several documents of a bounded sample share
    one_word: dict[str, float] = {}
    for r in found:
        for stem in (r["entry"][:k] + "*" for k in STEMS if r["entry"][-1] != "*" and len(r["entry"]) > k):
            one_word[stem] = max(r["t"], one_word.get(stem, 0))
    for r in found:
        if 2 * r["t"] >= 3 * one_word.get(r["entry"], 0):  # a stem that says little more than one word would only overreach
            entries[r["entry"]] = max(float(r["w"]), entries.get(r["entry"], 0.0))
    counts.unpersist()
    return entries


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_entries: int | None = None) -> Model:
    """Lexicon and curve from labelled rows outside the held-out fold.

    An entry is kept if most documents with it are toxic and that is no chance finding among all entries tried (its
    divergence from the base rate beats the logarithm of their number); its weight is the smoothed log odds. The curve
    is fitted on one half of the sample with a lexicon from the other, so it knows what a lexicon does on new rows.
    Without both labels the seeds and a default curve are used. `max_entries` keeps only the entries in most toxic documents;
    by default all are kept.
    """
    rows = training_rows(documents, labels, sample).withColumn("half", F.pmod("copy_key", F.lit(2))).persist()  # copies are on one side
    try:
        seen = match(rows.filter("half = 1"), Model(_lexicon(rows.filter("half = 0"), max_entries)), "toxic", "share").select("n_words", "weight", "toxic", "share").toPandas()  # at most `sample` rows
        both = 0 < int((seen["toxic"] > 0).sum()) < len(seen)
        entries = _lexicon(rows, max_entries)
        return Model(entries, curve=_fit_curve(seen["weight"], seen["n_words"], seen["toxic"] > 0, seen["share"] / WHOLE)) if both else Model(entries)
    finally:
        rows.unpersist()


def match(documents: DataFrame, model: Model, *carried: str) -> DataFrame:
    """(doc_id, n_words, n_matched, weight, carried ...) of every whole text."""
    kinds = dict(documents.dtypes)
    schema = ", ".join(["doc_id long", "n_words long", "n_matched long", "weight double", *(f"`{c}` {kinds[c]}" for c in carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            found = [matcher.weight(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), *(batch.column(c) for c in carried)],
                names=["doc_id", "n_words", "n_matched", "weight", *carried],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried).mapInArrow(run, schema)


def score(documents: DataFrame, model: Model, *carried: str) -> DataFrame:
    """One row per document: `score` in 0 to 1 and `predicted` = 1 from 0.5 on.

    Null and empty texts have no matches and get the curve's value at none; null ids and repeated rows pass through one
    by one; only doc_id, text and the carried columns are read; an empty table gives no rows. Very long texts take time in
    proportion to their length. A map over the scan without a shuffle.
    """
    a, b, c = (F.lit(x) for x in model.curve)
    dense = F.log1p(F.lit(100.0) * F.col("weight") / F.greatest(F.col("n_words"), F.lit(1)))
    value = 1 / (1 + F.exp(-(a + b * F.log1p("weight") + c * dense)))
    return match(documents, model, *carried).select("doc_id", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), "n_words", "n_matched", "weight", *carried)


def remove_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `documents` that are not predicted toxic, all columns as they were. Null and empty texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            found = [matcher.weight(t.as_py()) for t in batch.column(text)]
            toxic = (_features([f[2] for f in found], [f[0] for f in found]) @ np.array(model.curve) >= 0) & np.array([f[1] > 0 for f in found], bool)
            yield batch.filter(pa.array(~toxic))

    return documents.mapInArrow(run, documents.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(documents, learn(documents, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_matched")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
