"""Token counts of whole texts by a public tokenizer: batches go to the library, only lengths come back.

A text is cut where its tokens cannot reach across, so a very long one never is one call, and equal pieces need one
count. Distinct pieces are encoded in batches of about equal bytes, whatever the number of pieces, and their lengths are
summed per text; ids are never copied out of the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import binary_parts, id_and_text

LIMIT = 512
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of texts whose pieces are told apart together, and of pieces given to the library at once.
GROUP, BATCH = 4 << 20, 256 << 10
#: Bytes of pieces whose counts a worker remembers, twice over, and the longest such piece.
REMEMBERED, SHORT = 8 << 20, 64
_BYTES = np.arange(256)
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_VISIBLE = (_BYTES > 32) & (_BYTES < 127)


class Counter:
    """Numbers of tokens of pieces of text by a tokenizer file: `tokenizers` for .json, `sentencepiece` for .model.

    `cuts` says whether texts may be cut between a visible ASCII character and an ASCII blank. That holds for byte-level
    tokenizers with the usual word pattern: there no token but a run of blanks holds a blank after its first place, and
    the pattern looks ahead only from blanks. Nothing may stand before (a normaliser, added blanks), and no added token
    may hold a blank or take in those around it. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.most, self.held, self.counts, self.old = remembered, 0, {}, {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuts, self._lengths = False, lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self._lengths = lambda texts: list(map(len, t.encode_batch_fast(texts, add_special_tokens=False)))
        self.cuts = _may_cut(t)

    def count(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece. Short ones are remembered up to a number of bytes; that never changes a count."""
        out = [self._known(p) for p in pieces]
        todo = [i for i, n in enumerate(out) if n < 0]
        while todo:
            size, batch = 0, []
            while todo and size < BATCH:
                batch.append(todo.pop())
                size += len(pieces[batch[-1]])
            for i, n in zip(batch, self._lengths([pieces[i].decode("utf-8") for i in batch])):
                out[i] = n
                self._keep(pieces[i], n)
        return out

    def _known(self, piece: bytes) -> int:
        n = self.counts.get(piece)
        if n is None:
            n = self.old.get(piece, -1)
            if n >= 0:
                self._keep(piece, n)
        return n

    def _keep(self, piece: bytes, n: int) -> None:
        if len(piece) > SHORT:
            return
        if self.held > self.most:
            self.old, self.counts, self.held = self.counts, {}, 0
        self.counts[piece] = n
        self.held += len(piece)


def _may_cut(tokenizer) -> bool:
    import json

    spec = json.loads(tokenizer.to_str())
    before = spec["pre_tokenizer"] or {}
    added = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not any(c.isspace() for c in a["content"]) for a in spec["added_tokens"])
    return spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and added


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """One per worker process and tokenizer."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_column(column: pa.Array, counter: Counter, group: int = GROUP) -> np.ndarray:
    """Tokens of every text of an Arrow column; null counts as empty."""
    data, at = binary_parts(column)
    out, first = np.zeros(len(at) - 1, np.int64), 0
    while first < len(out):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + group, "right")) - 1)
        raw, bounds = data[at[first] : at[stop]], at[first : stop + 1] - at[first]
        edges = bounds
        if counter.cuts and len(raw):
            edges = np.union1d(bounds, np.flatnonzero(_VISIBLE[raw[:-1]] & _BLANK[raw[1:]]) + 1)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        n = np.asarray(counter.count(pieces.dictionary.to_pylist()), np.int64)[pieces.indices.to_numpy()]
        sums = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(edges, bounds)] if len(n) else np.zeros(len(bounds), np.int64)
        out[first:stop] = np.diff(sums)
        first = stop
    return out


SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of `documents`: a map without a shuffle.

    `tokenizer` is the path of a .json or .model file that every worker can read. Special strings in a text are what the
    library makes of them by default; nothing is added, cut off or padded. Null and empty texts have no bytes and no
    tokens; null and repeated ids and repeated texts stay rows of their own; no other column is read; an empty table
    gives an empty result. Texts of any length work: memory follows a few megabytes of text, or the one longest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for batch in batches:
            _, at = binary_parts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(count_column(batch.column("text"), counter))], names=["doc_id", "n_bytes", "n_tokens"])

    return id_and_text(documents, key, text).mapInArrow(run, SCHEMA)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE: dict[str, str] = {}
