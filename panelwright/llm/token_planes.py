"""Token ids as shuffled planes: fixed-size blocks of ids, transposed into bit or byte planes, each compressed on its own.

A dataset is a folder with three tables. `chunks` holds one row per block: its shard and number, its offset in the
shard, how many ids it has, which documents they belong to, and the zstandard frames of its planes, one after another,
with their lengths. `shards` says where each shard starts among all ids. `index` has one small row per block, with its
start among all ids, and finds any range of ids without touching data. Spark's commit protocol makes the files whole whatever executors are lost.
Shards follow the ids of the documents in ascending order; a shard's last block may be shorter.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.words import binary_parts, id_and_text

BLOCK = 1 << 16
END = 1
LEVEL = 1
#: Bytes of stretches of text between ASCII blanks whose ids a worker remembers, twice over; longer stretches than SHORT
#: are encoded each time, and an entry costs about ENTRY bytes besides its own.
REMEMBERED, SHORT, ENTRY = 64 << 20, 64, 180


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of 32-bit ids, lowest first: 4 byte planes, or 32 bit planes of eight ids a byte."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """Inverse of to_planes."""
    if not bits:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()[:n]
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.ascontiguousarray(np.packbits(each, axis=1, bitorder="little")).view("<u4").ravel()


_LATIN_END = "\u0250"
_BYTES = np.arange(256)
_LETTER = (_BYTES >= 97) & (_BYTES <= 122)
_MARK = (_BYTES == ord(".")) | (_BYTES == ord(","))


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts by a public tokenizer file; a dictionary of the stretches between ASCII blanks and their ids.

    Only for byte-level tokenizers whose normaliser folds case and white space and whose words never cross white space:
    there a text's ids are those of its stretches one after another, and a blank between a letter and a full stop or
    comma changes nothing. A-Z are folded first, except before a byte beyond ASCII: the normaliser composes before it
    folds, and some letters have a composed form in lower case only. A new stretch of Latin letters goes through the library's normaliser and model alone (it is
    one word); any other goes through the whole library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.held, self.old = Tokenizer.from_file(path), remembered, 0, {}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._normal, self._tokenize, self._alphabet = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize, _byte_letters()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, stretch: bytes) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            word = stretch.decode("utf-8")
            if word.isalpha() and max(word) < _LATIN_END:
                plain = word if word.isascii() else self._normal(word)
                letters = plain if plain.isascii() else plain.encode("utf-8").decode("latin-1").translate(self._alphabet)
                ids = array("I", [t.id for t in self._tokenize(letters)]).tobytes() if plain.isalpha() else self._whole(word)
            else:
                ids = self._whole(word)
        if len(stretch) <= SHORT:
            self[stretch] = ids
            self.held += len(stretch) + len(ids) + ENTRY
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for text in texts:
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            low = text.lower()
            if any(t in low for t in self.special):  # folding must not make one either
                out.append(self._whole(text.decode("utf-8")))
                continue
            data = np.frombuffer(low, np.uint8)
            if not text.isascii():
                raw = np.frombuffer(text, np.uint8)
                kept = np.flatnonzero((raw[:-1] != data[:-1]) & (raw[1:] >= 128))
                data = data.copy()
                data[kept] = raw[kept]
            at = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
            out.append(b"".join(map(self.__getitem__, np.insert(data, at, 32).tobytes().split())))
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: the tasks it runs share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


CHUNK_SCHEMA = "shard int, chunk int, offset long, continues boolean, n_ids int, bits boolean, lengths array<int>, frames binary, documents array<struct<number:long, doc_id:long, n_ids:int, ends:boolean>>"
_DOCUMENT = pa.struct([("number", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int32()), ("ends", pa.bool_())])


def _chunk_row(shard: int, chunk: int, block: int, continues: bool, ids: np.ndarray, bits: bool, documents: list[dict], squeeze) -> pa.RecordBatch:
    frames = [squeeze.compress(p) for p in to_planes(ids, bits)]
    return pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([chunk * block], pa.int64()), pa.array([continues]), pa.array([len(ids)], pa.int32()), pa.array([bits]),
        pa.array([[len(f) for f in frames]], pa.list_(pa.int32())), pa.array([b"".join(frames)], pa.binary()), pa.array([documents], pa.list_(_DOCUMENT)),
    ], names=["shard", "chunk", "offset", "continues", "n_ids", "bits", "lengths", "frames", "documents"])


def write_token_planes(documents: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", bits: bool = False, block: int = BLOCK, end: int = END) -> None:
    """Encode every whole text, append the end id, and write the dataset, in byte planes or with `bits` in bit planes.

    Byte planes of a public vocabulary's ids compress better and cost a fifth; bit planes suit ids of few bits.

    Null and empty texts have the end id alone; null document ids come first; rows with the same id follow one another;
    an empty table gives a dataset without blocks; a text longer than a block spans several. A worker holds one batch of
    texts and one block.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = id_and_text(documents, key, text).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    laid = laid.select(F.spark_partition_id().alias("shard"), "doc_id", F.col("text").cast("binary").alias("text"))
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = encoder_of(tokenizer), zstandard.ZstdCompressor(LEVEL)
        shard = chunk = number = 0
        held, inside, docs, continues = [], 0, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py()
            data, at = binary_parts(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for lo in range(0, len(names), 256):
                raw = [data[a:b].tobytes() for a, b in zip(at[lo : lo + 256].tolist(), at[lo + 1 : lo + 257].tolist())]
                for name, code in zip(names[lo : lo + 256], encoder.encode(raw)):
                    ids = np.frombuffer(code + mark, "<u4")
                    while inside + len(ids) >= block:
                        take = block - inside
                        held.append(ids[:take])
                        docs.append({"number": number, "doc_id": name, "n_ids": take, "ends": take == len(ids)})
                        yield _chunk_row(shard, chunk, block, continues, np.concatenate(held), bits, docs, squeeze)
                        ids, chunk, held, inside, docs, continues = ids[take:], chunk + 1, [], 0, [], take < len(ids)
                        if not len(ids):
                            break
                    if len(ids):
                        held.append(ids)
                        inside += len(ids)
                        docs.append({"number": number, "doc_id": name, "n_ids": len(ids), "ends": True})
                    number += 1
        if held:
            yield _chunk_row(shard, chunk, block, continues, np.concatenate(held), bits, docs, squeeze)

    laid.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = documents.sparkSession.read.parquet(f"{path}/chunks").select("shard", "chunk", "offset", "n_ids", F.size("documents").alias("n_documents"))
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))  # one row per shard: as many as partitions
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("shard", "n_ids", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{path}/shards")
    chunks.join(_starts(documents.sparkSession, path), "shard").select("shard", "chunk", "n_ids", "n_documents", (F.col("start") + F.col("offset")).alias("start")).write.parquet(f"{path}/index")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """First id of every shard, for broadcast: as many rows as the writer had partitions."""
    return F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "start"))


def _decoded(row: dict, expand) -> np.ndarray:
    ends = np.cumsum([0, *row["lengths"]])
    planes = [expand.decompress(row["frames"][a:b]) for a, b in zip(ends[:-1], ends[1:])]
    return from_planes(planes, row["n_ids"], row["bits"])


def _pieces(whole: bool):
    """Documents of blocks: those within one block, or the pieces of those that span several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                cuts = np.cumsum([0, *(d["n_ids"] for d in row["documents"])])
                last = len(row["documents"]) - 1
                spans = [(i == 0 and row["continues"]) or (i == last and not d["ends"]) for i, d in enumerate(row["documents"])]
                picked = [i for i, s in enumerate(spans) if s != whole]
                if not picked:
                    continue
                raw = _decoded(row, expand).tobytes()
                chosen = [row["documents"][i] for i in picked]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(picked), pa.int32()), pa.array([d["number"] for d in chosen], pa.int64()), pa.array([d["doc_id"] for d in chosen], pa.int64()), pa.array([row["chunk"]] * len(picked), pa.int32()),
                    pa.array([row["start"] + row["offset"] + int(cuts[i]) for i in picked], pa.int64()), pa.array([raw[4 * cuts[i] : 4 * cuts[i + 1]] for i in picked], pa.binary()),
                ], names=["shard", "number", "doc_id", "chunk", "start", "ids"])

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files; `ids` are little-endian 32-bit.

    Blocks are decoded independently. Only the pieces of documents that span blocks (two a block, or one very long text)
    are shuffled to be joined.
    """
    blocks = spark.read.parquet(f"{path}/chunks").join(_starts(spark, path), "shard")
    schema = "shard int, number long, doc_id long, chunk int, start long, ids binary"
    whole = blocks.mapInArrow(_pieces(True), schema).select("doc_id", "start", "ids")
    pieces = blocks.mapInArrow(_pieces(False), schema).groupBy("shard", "number").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("p"))
    joined = pieces.select("doc_id", "start", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    return whole.unionByName(joined).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of the whole sequence: the index names the blocks, and only these are read."""
    index = spark.read.parquet(f"{path}/index").filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    rows = spark.read.parquet(f"{path}/chunks").join(F.broadcast(index.select("shard", "chunk", "start")), ["shard", "chunk"]).orderBy("start").collect()
    expand = zstandard.ZstdDecompressor()
    parts = [_decoded(r.asDict(), expand)[max(0, start - r["start"]) : stop - r["start"]] for r in rows]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def op2_token_planes(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from panelwright.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/planes/{uuid.uuid4().hex}"
    write_token_planes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_planes": op2_token_planes}
ORACLE: dict[str, str] = {}
