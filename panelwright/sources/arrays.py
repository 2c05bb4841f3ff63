"""Numeric arrays in `.npy` files (or stored members of `.npz`) as tables whose partitions are ranges of rows.

A row is everything below the first axis, flattened. The header gives the shape and the place of the first number, so a
task seeks to its rows and reads nothing else: a file of any size is read by as many tasks as its bytes ask for, a few
megabytes at a time. Only headers are opened while the plan is built.
"""

from __future__ import annotations

import math
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of an array that one task reads, and that it holds at once.
SPLIT, HELD = 64 << 20, 4 << 20
FORMAT = "array_rows"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path; every task has to reach it."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """The file itself, or the array files of a folder in order of name."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith((".npy", ".npz")) and not f.base_name.startswith((".", "_"))]
    if not found:
        raise FileNotFoundError(f"no arrays in {path}")
    return sorted(path.rstrip("/") + "/" + f.rsplit("/", 1)[1] for f in found)


@dataclass(frozen=True)
class ArrayHeader:
    """What is needed to read rows by offset."""

    path: str
    dtype: str
    shape: tuple[int, ...]
    start: int

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize


def read_header(path: str, member: str | None = None) -> ArrayHeader:
    """Header of an array; refuses what cannot be cut into rows: object arrays, column order, compressed members, scalars."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        start = 0
        if path.endswith(".npz"):
            with zipfile.ZipFile(f) as z:
                info = z.getinfo(f"{member}.npy")
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{path}: {member} is compressed, so its rows have no offsets")
            f.seek(info.header_offset + 26)
            name, extra = np.frombuffer(f.read(4), "<u2").tolist()
            start = info.header_offset + 30 + name + extra
        f.seek(start)
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(f)
        start = f.tell()
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"{path}: arrays of {dtype} are not read")
    if not shape or (by_column and len(shape) > 1):
        raise ValueError(f"{path}: needs rows along the first axis, stored one after another")
    return ArrayHeader(path, dtype.str, tuple(shape), start)


@dataclass
class RowRange(InputPartition):
    header: ArrayHeader
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.split = int(options.get("splitbytes", SPLIT))
        self.headers = [read_header(p, options.get("member")) for p in _files(options["path"])]

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for h in self.headers:
            step = max(1, self.split // max(h.row_bytes, 1))
            out += [RowRange(h, a, min(a + step, h.shape[0])) for a in range(0, h.shape[0], step)]
        return out or [RowRange(self.headers[0], 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        h, step = partition.header, max(1, HELD // max(partition.header.row_bytes, 1))
        system, at = _open(h.path)
        with system.open_input_file(at) as f:
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                f.seek(h.start + a * h.row_bytes)
                values = np.frombuffer(f.read(n * h.row_bytes), h.dtype).astype(np.float64)
                if len(values) != n * h.width:
                    raise ValueError(f"{h.path} ends before row {a + n}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, h.width, dtype=np.int32) if h.width else np.zeros(n + 1, np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([h.path] * n), pa.array(np.arange(a, a + n)), lists], names=["file", "row", "cells"])


class ArrayRows(DataSource):
    """`spark.read.format("array_rows").load(path)`: (file, row, cells). Options: `member` of an .npz, `splitBytes`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, row long, cells array<double>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)


def read_array(spark: SparkSession, path: str, member: str | None = None, split: int = SPLIT) -> DataFrame:
    """Rows of an array file, or of all array files of a folder: (file, row, cells)."""
    spark.dataSource.register(ArrayRows)
    reader = spark.read.format(FORMAT).option("splitBytes", str(split))
    return (reader.option("member", member) if member else reader).load(path)


def read_tensor(spark: SparkSession, path: str, member: str | None = None, split: int = SPLIT) -> DataFrame:
    """Rows of arrays with three axes of one size below the first: (file, row, tensor array<array<double>>)."""
    shapes = {read_header(p, member).shape[1:] for p in _files(path)}
    if len(shapes) != 1 or len(next(iter(shapes))) != 2:
        raise ValueError(f"{path}: needs (rows, steps, features), found {sorted(shapes)}")
    steps, features = next(iter(shapes))
    tensor = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice("cells", i * features + 1, F.lit(features)))
    return read_array(spark, path, member, split).select("file", "row", tensor.alias("tensor"))


def write_array(df: DataFrame, path: str, cells: str, file_bytes: int = SPLIT) -> DataFrame:
    """Write `.npy` files of doubles, of about `file_bytes` at most, into a new folder: (file, rows) of what was written.

    Every row has an equally long array. A task holds the rows of one file, whose header needs their number. A file gets
    its name when it is complete, and the name follows from the partition, so a repeated task does no harm.
    """
    system, at = _open(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, base = _open(path)
        number, files, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal files, held, size
            block, name, hidden = np.concatenate(held), f"part-{number:05d}-{files:05d}.npy", f"{base}/.{uuid.uuid4().hex}"
            with out.open_output_stream(hidden) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": block.shape})
                f.write(block.tobytes())
            out.move(hidden, f"{base}/{name}")
            files, held, size = files + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(block)], pa.int64())], names=["file", "rows"])

        for batch in batches:
            if batch.num_rows:
                column = batch.column("cells")
                held.append(column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(column), -1))
                size += held[-1].nbytes
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    written = df.select(F.col(cells).cast("array<double>").alias("cells")).mapInArrow(run, "file string, rows long")
    return df.sparkSession.createDataFrame([tuple(r) for r in written.collect()], "file string, rows long")  # one row a file
