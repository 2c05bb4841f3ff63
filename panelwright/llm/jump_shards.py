"""Sharding by jump consistent hashing (Lamping and Veach), in DataFrame functions only.

A key and the number of shards decide the shard; there is no ring table. Growing from n to n + 1 shards moves a key only
into the new shard, and an expected 1 / (n + 1) of all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.ranking import number_within
from panelwright.session import cut_lineage

SHARDS = 40
#: Fixed values of the published algorithm: the generator's multiplier and modulus.
MULTIPLIER, MODULUS = 2862933555777941757, 1 << 64
#: Jumps of the first round (a key makes about ln(shards) of them); a second round takes whatever is left.
JUMPS = 48


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _jump(state: Column, shards: Column) -> Column:
    """One jump: state is (key, shard, next candidate)."""
    key = F.pmod(state["key"] * _decimal(MULTIPLIER).cast("decimal(19,0)") + F.lit(1), _decimal(MODULUS)).cast("decimal(20,0)")

    def to(k: Column) -> Column:
        high = F.floor(k / _decimal(1 << 33)).cast("double")
        reach = F.floor((state["to"].cast("double") + 1.0) * (F.lit(2147483648.0) / (high + 1.0))).cast("long")
        return F.struct(k.alias("key"), state["to"].alias("at"), reach.alias("to"))

    moved = F.transform(F.array(key), to)[0]
    return F.when(state["to"] < shards, moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to `shards` - 1 of a 64-bit key (hash other keys first); null counts as key 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    n = F.lit(shards).cast("long")
    start = F.struct(F.pmod(F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)"), _decimal(MODULUS)).cast("decimal(20,0)").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))

    def run(state: Column, most: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, lambda s, _: _jump(s, n))

    first = F.transform(F.array(run(start, min(JUMPS, shards))), lambda s: F.when(s["to"] >= n, s["at"]).otherwise(run(s, shards)["at"]))[0]
    return first.cast("int")


def jump_shards(documents: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `documents`: size, shard, place in the shard, and the shard once there is one more.

    A null id counts as key 0; a null text has size 16 and the checksum of no bytes; rows with the same id share a shard
    and get places of their own; no other column is read. Texts are read once and never shuffled; hot shards are
    numbered over many tasks.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = cut_lineage(documents.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"), jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    ))
    return number_within(narrow, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op4_jump_shards(spark, sf_dir: str) -> DataFrame:
    placed = jump_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _oracle(n: int) -> str:
    def shard(top: int) -> str:
        return f"(SELECT doc_id, max(j)::INTEGER AS s FROM jumps WHERE j < {top} GROUP BY doc_id)"

    return f"""
WITH RECURSIVE jumps AS (
  SELECT DISTINCT doc_id, ((doc_id::HUGEINT % {MODULUS}) + {MODULUS}) % {MODULUS} AS k, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, k, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592)::DOUBLE + 1)))::BIGINT AS j FROM (SELECT doc_id, (k * {MULTIPLIER} + 1) % {MODULUS} AS k, j FROM jumps WHERE j <= {n})),
steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
crc AS (SELECT text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS c
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), steps)
SELECT d.doc_id, (octet_length(encode(c.text)) + 16)::BIGINT AS size, c.c::BIGINT AS text_crc32, 'key' AS law, a.s AS shard,
  row_number() OVER (PARTITION BY a.s ORDER BY d.doc_id) - 1 AS slot, b.s AS grown_shard
FROM documents d JOIN crc c ON c.text = coalesce(d.text, '') JOIN {shard(n)} a ON a.doc_id = d.doc_id JOIN {shard(n + 1)} b ON b.doc_id = d.doc_id
"""


QUERIES = {"op4_jump_shards": op4_jump_shards}
ORACLE = {"op4_jump_shards": _oracle(SHARDS)}
