"""URL filters: a sorted array of 64-bit digests, memory-mapped by the workers, with the full strings to confirm a hit.

Entries are `host/path`: one fits its host and all subdomains when the url's path starts with the entry's. The list is
digested and ranged by Spark, and each task writes its range as three plain files in the shared folder: sorted digests,
the strings' ends, the strings. Workers map them, so a long list costs no heap and never passes the driver, which sees
a row per range and the list's shapes (labels of the host, length of the path). Lookups are vectorised binary searches.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.kneser_ney import load, shared_folder

#: The rules of the report.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The start of the operator's own list, for urls that no rule fits; the sections of tracking links join it.
LISTED = [("block", "example.org/de/"), ("block", "tionsh.example.com/"), ("block", "blog.example.com/es/"), ("allow", "tionsh.example.com/en/")]

#: Parameters that links of feeds and campaigns carry.
TRACKED = "[?&](ref|utm_[a-z]+)="


def _digest(entry: str | bytes) -> int:
    return xxhash.xxh64_intdigest(entry)


@dataclass
class ListFiles:
    """Where a list lies: its ranges in digest order with their first digests, and the shapes its entries have."""

    folder: str
    names: list[str]
    firsts: list[int]
    shapes: list[tuple[int, int]]


def write_digest_list(entries: DataFrame) -> ListFiles:
    """Files of the distinct (entry, action) rows; null entries are left out, of two actions for one entry "block" holds.

    A task streams its range to files of its own name and hands that name on, so a repeated task does no harm.
    """
    spark = entries.sparkSession
    folder = shared_folder(spark, "digests")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = np.array([_digest(e) for e in batch.column("entry").to_pylist()], np.uint64)
            signed = (digests ^ np.uint64(1 << 63)).view(np.int64)  # so that signed order is the digests' order
            yield pa.RecordBatch.from_arrays([pa.array(signed), batch.column("entry"), batch.column("action")], names=["at", "entry", "action"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, end = uuid.uuid4().hex, None, 0
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}.digests", "wb") as digests, open(f"{folder}/{name}.ends", "wb") as ends, open(f"{folder}/{name}.strings", "wb") as strings:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.column("at").to_numpy()
                bodies = [f"{a[0]}{e}".encode() for e, a in zip(batch.column("entry").to_pylist(), batch.column("action").to_pylist())]
                places = end + np.cumsum([len(b) for b in bodies], dtype=np.uint64)
                first = int(at[0]) if first is None else first
                (at.view(np.uint64) ^ np.uint64(1 << 63)).tofile(digests)
                places.tofile(ends)
                strings.write(b"".join(bodies))
                end = places[-1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64())], names=["name", "first"])

    kept = entries.filter("entry is not null").groupBy("entry").agg(F.max("action").alias("action"))
    ranges = kept.mapInArrow(digested, "at long, entry string, action string").repartitionByRange("at").sortWithinPartitions("at").mapInArrow(write, "name string, first long")
    found = sorted((r["first"] + (1 << 63), r["name"]) for r in ranges.collect())  # a row per range
    host, path = F.split_part("entry", F.lit("/"), F.lit(1)), F.length("entry") - F.locate("/", "entry") + 1
    shapes = entries.filter("contains(entry, '/')").select((F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1).alias("labels"), path.alias("path")).distinct()
    return ListFiles(folder, [name for _, name in found], [first for first, _ in found], sorted(map(tuple, shapes.collect())))  # at most labels x lengths


class DigestList:
    """A memory-mapped list: per range its digests, the ends of its strings, and the strings."""

    def __init__(self, files: ListFiles):
        self.firsts, self.shapes = np.array(files.firsts, np.uint64), files.shapes
        self.parts = [(load(files.folder, f"{n}.digests", np.uint64), load(files.folder, f"{n}.ends", np.uint64), load(files.folder, f"{n}.strings", np.uint8)) for n in files.names]

    def entry(self, part: int, i: int) -> tuple[str, str]:
        """(entry, action)."""
        _, ends, strings = self.parts[part]
        raw = strings[int(ends[i - 1]) if i else 0 : int(ends[i])].tobytes().decode()
        return raw[1:], {"a": "allow", "b": "block"}[raw[0]]

    def entries(self) -> Iterator[str]:
        return (self.entry(p, i)[0] for p, part in enumerate(self.parts) for i in range(len(part[0])))

    def find(self, candidates: list[str]) -> list[str | None]:
        """Action of each candidate that the list holds, else None."""
        out: list[str | None] = [None] * len(candidates)
        if not candidates or not self.parts:
            return out
        wanted = np.array([_digest(c) for c in candidates], np.uint64)
        owner = np.searchsorted(self.firsts, wanted, "right") - 1
        for p in np.unique(owner[owner >= 0]).tolist():
            mine, digests = np.flatnonzero(owner == p), self.parts[p][0]
            at = np.searchsorted(digests, wanted[mine])
            for j in np.flatnonzero(digests[np.minimum(at, len(digests) - 1)] == wanted[mine]).tolist():
                k, i = int(mine[j]), int(at[j])
                while i < len(digests) and digests[i] == wanted[k]:  # other entries may share the digest
                    entry, action = self.entry(p, i)
                    if entry == candidates[k]:
                        out[k] = action
                        break
                    i += 1
        return out


def candidates(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """Every entry that could fit: the last labels of the host with the path's beginning, for each shape a list has.

    Parents with more labels than any entry are never built, so a host of many dots costs no more than a usual one.
    """
    if not host or path[:1] != "/":
        return []
    most = max((m for m, _ in shapes), default=0)
    labels = host.rsplit(".", most)[-most:] if most else []
    parents = {m: ".".join(labels[-m:]) for m in {m for m, _ in shapes} if m <= len(labels)}
    return [f"{parents[m]}{path[:n]}" for m, n in shapes if m in parents and n <= len(path)]


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url; both empty without `://`."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, lists: list[ListFiles], key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, and per list k: entry_k, action_k of the longest fitting entry, else null).

    Null and malformed urls have an empty host and path and fit nothing; entries without a path never fit; of entries of
    one length the one with the longer host wins; repeated rows and other columns do not matter; hosts and paths may have
    any length; an empty table gives no rows. A map without a shuffle.
    """
    host, path = host_and_path(url)
    schema = ", ".join(["page_id long", "host string", "path string", *(f"entry_{k} string, action_{k} string" for k in range(len(lists)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [DigestList(files) for files in lists]
        for batch in batches:
            urls = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            columns = [batch.column("page_id"), batch.column("host"), batch.column("path")]
            for listed in maps:
                tries = [candidates(h, p, listed.shapes) for h, p in urls]
                found = iter(listed.find([c for t in tries for c in t]))
                best = [max(((len(c), c.index("/"), c, a) for c in t if (a := next(found))), default=(0, 0, None, None)) for t in tries]
                columns += [pa.array([b[2] for b in best], pa.string()), pa.array([b[3] for b in best], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", *(n for k in range(len(lists)) for n in (f"entry_{k}", f"action_{k}"))])

    return pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(run, schema)


def tracked_sections(pages: DataFrame, url: str = "url", least: int = 3, share: float = 0.5) -> DataFrame:
    """(entry, action "block") of the sections `host/first folder/` that mostly live on tracking links.

    A section counts with at least `least` pages (repeated rows count again) of which the given share carry a `ref` or
    `utm_...` parameter; null and malformed urls have none. Only the urls are read, and Spark adds up before it shuffles.
    """
    host, path = host_and_path(url)
    folder = F.regexp_extract(path, r"^(/[^/]*/)", 1)
    rows = pages.select(host.alias("host"), folder.alias("folder"), F.coalesce(F.col(url).rlike(TRACKED), F.lit(False)).cast("int").alias("tracked"))
    sections = rows.filter("host <> '' and folder <> ''").groupBy(F.concat("host", "folder").alias("entry")).agg(F.count(F.lit(1)).alias("n"), F.sum("tracked").alias("tracked"))
    return sections.filter((F.col("n") >= least) & (F.col("tracked") >= F.col("n") * share)).select("entry", F.lit("block").alias("action"))


def literal_entries(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(e, a) for a, e in entries], "entry string, action string")


def digest_list(spark: SparkSession, entries: list[tuple[str, str]]) -> ListFiles:
    """Files of a literal list of (action, entry)."""
    return write_digest_list(literal_entries(spark, entries))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lists = [digest_list(spark, RULES), write_digest_list(literal_entries(spark, LISTED).unionByName(tracked_sections(pages)))]
    judged = judge(pages, lists)
    return judged.select("page_id", "host", "path", F.col("entry_0").alias("rule"), F.coalesce("action_0", "action_1", F.lit("allow")).alias("verdict"))


def _oracle() -> str:
    def values(rules) -> str:
        return "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{e.partition('/')[0]}', '/{e.partition('/')[2]}')" for a, e in rules) + ") AS v(action, h, p))"

    learned = f"""(SELECT max(action) AS action, h, p FROM (SELECT * FROM {values(LISTED)} UNION ALL
SELECT 'block', host, regexp_extract(path, '^(/[^/]*/)', 1) FROM u WHERE host <> '' AND regexp_matches(path, '^/[^/]*/') GROUP BY ALL
HAVING count(*) >= 3 AND 2 * count(*) FILTER (WHERE regexp_matches(url, '{TRACKED}')) >= count(*)) GROUP BY ALL)"""

    def best(rules) -> str:
        return f"(SELECT page_id, url, arg_max(action, length(h || p) * 10000 + length(h)) AS action, arg_max(h || p, length(h || p) * 10000 + length(h)) AS rule FROM u, {rules} v WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)"

    return f"""
WITH x AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
u AS (SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM x)
SELECT u.page_id, u.host, u.path, a.rule, coalesce(a.action, b.action, 'allow') AS verdict
FROM u LEFT JOIN {best(values(RULES))} a ON a.page_id = u.page_id AND a.url IS NOT DISTINCT FROM u.url LEFT JOIN {best(learned)} b ON b.page_id = u.page_id AND b.url IS NOT DISTINCT FROM u.url
"""


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE = {"op6_url_filter": _oracle()}
