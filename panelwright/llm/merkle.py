"""A Merkle manifest of a table: per-row digests, one tree per group, one tree over the groups, a proof for every row.

Nodes of a level are 64 hex digits each, so a level of an aligned block of nodes is one string: parents are the hashes of
its substrings of three nodes, and the siblings of a node are what flanks it in its substring. A block of `FAN ** HEIGHT`
nodes climbs to one node; blocks of a group climb independently, and their roots are the nodes of the next round, until
each group has one. A group of any size is thus many rows of bounded length. Everything is a SQL expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.ranking import number_within
from panelwright.session import cut_lineage

#: Children of a node, levels that a block climbs, and hex digits of a node.
FAN, HEIGHT, HEX = 3, 5, 64
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over all fields in order: `-` for null, else the byte count, `:` and the value."""
    def piece(c: Column) -> Column:
        value = c.cast("string").cast("binary")
        return F.coalesce(F.concat(F.octet_length(value).cast("string").cast("binary"), F.lit(":").cast("binary"), value), F.lit("-").cast("binary"))

    return F.sha2(F.concat(*[piece(c) for c in fields]), 256)


# --- one block ------------------------------------------------------------------------------

def _nodes(level: Column) -> Column:
    return F.floor(F.octet_length(level) / HEX).cast("int")


def _parents(level: Column) -> Column:
    """The next level: the hashes of every `FAN` nodes."""
    runs = F.sequence(F.lit(0), F.floor((_nodes(level) - 1) / FAN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "").cast("binary")


def _levels(level: Column, others: Column, height: int) -> Column:
    """All levels of a block, its root last. A single node climbs on only if the group has `others`, as they do."""
    def up(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(others | (_nodes(top) > 1), F.concat(levels, F.array(_parents(top)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(level.cast("binary")), up)


def _siblings(levels: Column, place: Column) -> Column:
    """Per level below the root, lowest first: what stands before and after the node above `place` in its run."""
    below = F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda k: k < F.size(levels) - 1)

    def flank(k: Column) -> Column:
        level, node = F.element_at(levels, k + 1), F.floor(place / F.pow(F.lit(float(FAN)), k.cast("double"))).cast("int")
        own, start = node * HEX, F.floor(node / FAN).cast("int") * (FAN * HEX)
        before, after = F.substring(level, start + 1, own - start), F.substring(level, own + HEX + 1, start + (FAN * HEX - HEX) - own)
        return F.struct(before.cast("string").alias("before"), after.cast("string").alias("after"))

    return F.transform(below, flank)


def climb(nodes: DataFrame, group: Sequence[str], height: int = HEIGHT) -> list[DataFrame]:
    """Rounds of aligned blocks of `nodes` (group, place from 0, hash, carried columns); in the last every group is one block.

    A block is (group, block, members, levels). A round divides the largest group by `FAN ** height`, so their number is
    its logarithm; each round is written once, and after the first they are small. Group columns must not be null.
    """
    width, rounds = FAN**height, []
    carried = [c for c in nodes.columns if c not in (*group, "place", "hash")]
    while True:
        member = F.struct((F.col("place") % width).cast("int").alias("at"), "hash", *carried)
        blocks = nodes.groupBy(*group, F.floor(F.col("place") / width).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
        lowest = F.array_join(F.transform("members", lambda m: m["hash"]), "")
        # a first block with others is full, and climbs all the way by itself
        rounds.append(cut_lineage(blocks.withColumn("levels", _levels(lowest, F.col("block") > 0, height))))
        if rounds[-1].where(F.col("block") > 0).limit(1).count() == 0:
            return rounds
        nodes, carried = rounds[-1].select(*group, F.col("block").alias("place"), F.element_at("levels", -1).cast("string").alias("hash")), []


def group_roots(rounds: list[DataFrame], group: Sequence[str]) -> DataFrame:
    """(group, hash): the one node that is left of each group."""
    return rounds[-1].select(*group, F.element_at("levels", -1).cast("string").alias("hash"))


def descend(rounds: list[DataFrame], group: Sequence[str], tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes that `climb` was given, with the columns of `tops` and `path`, the siblings from the node to the top.

    `tops` has one row per group with the `path` beyond its root. Paths are handed down from block to block and reach
    rows inside their block, so nothing is joined row by row and no key holds more than a block.
    """
    above, on = tops, list(group)
    for i, blocks in reversed(list(enumerate(rounds))):
        handed = [c for c in above.columns if c not in (*on, "path")]
        rows = F.transform("members", lambda m: F.struct(m.alias("m"), _siblings(F.col("levels"), m["at"]).alias("own")))
        opened = blocks.join(above, on).select(*group, "block", *handed, "path", F.explode(rows).alias("r"))
        path = F.concat("r.own", "path").alias("path")
        if i == 0:
            return opened.select(*group, *handed, "r.m.*", path).drop("at")
        above = cut_lineage(opened.select(*group, (F.col("block") * FAN**height + F.col("r.m.at")).alias("block"), *handed, path))
        on = [*group, "block"]
    raise ValueError("no rounds")


# --- a table --------------------------------------------------------------------------------

def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def merkle_manifest(
    df: DataFrame, group: str = "source", key: str = "doc_id", fields: Sequence[str] = LEAF_FIELDS, carry: Mapping[str, Column] | None = None, height: int = HEIGHT
) -> DataFrame:
    """One row per row of `df`: key, group, leaf, subroot, root, path, and the `carry` columns, computed next to the leaf.

    Leaves ascend by key within their group (null first; rows with equal keys by their digests), groups by their bytes
    (null first, a group of its own, not the same as an empty name). Null and empty fields differ; whole texts of any
    length are hashed; repeated rows are leaves of their own; other columns are not read; an empty table gives no rows.
    Rows are hashed in the scan and move as digests only. A group of any size is spread: its numbers come from a range
    layout, its blocks have bounded length.
    """
    extra = dict(carry or {})
    known = F.col(group).isNotNull()
    leaves = cut_lineage(df.select(
        known.alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col(key).alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("hash"), *[c.alias(f"c_{k}") for k, c in extra.items()],
    ))
    by = ["known", "name"]
    rounds = climb(number_within(leaves, by, ["id", "hash"], "place"), by, height)
    subroots = number_within(group_roots(rounds, by), [], by, "place").withColumn("all", F.lit(0))
    upper = climb(subroots.select("all", "place", "hash", *by), ["all"], height)
    top = group_roots(upper, ["all"]).select("all", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(upper, ["all"], top, height).select(*by, F.col("hash").alias("subroot"), "root", "path")
    rows = descend(rounds, by, tops, height)
    return rows.select(F.col("id").alias(key), F.when(F.col("known"), F.col("name")).alias(group), F.col("hash").alias("leaf"), "subroot", "root", "path", *[F.col(f"c_{k}").alias(k) for k in extra])


def check_rows(df: DataFrame, manifest: DataFrame, key: str = "doc_id", fields: Sequence[str] = LEAF_FIELDS) -> DataFrame:
    """(key, leaf, folded_root, verified) of every row of a table against the path of its key in a manifest of unique keys.

    A key that the manifest does not have is not verified.
    """
    rows = df.select(F.col(key).alias("_key"), leaf_digest([F.col(f) for f in fields]).alias("leaf"))
    paths = manifest.select(F.col(key).alias("_other"), "root", "path")
    found = rows.join(paths, F.col("_key").eqNullSafe(F.col("_other")), "left").withColumn("folded_root", folded(F.col("leaf"), F.col("path")))
    return found.select(F.col("_key").alias(key), "leaf", "folded_root", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)).alias("verified"))


def tamper_report(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: its digests and proof, and whether it still verifies.

    In half of the documents, chosen by the checksum of their ids (a null id is not), line ends are deleted from the text
    before its way to the root is recomputed.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    stripped = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in LEAF_FIELDS]
    tampered = F.when(chosen & F.contains("text", F.lit("\n")), leaf_digest(stripped))
    rows = merkle_manifest(documents, carry={"tampered": tampered}, height=height).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return tamper_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(group_levels: int = 20, root_levels: int = 10) -> str:
    """Level by level over whole tables of nodes, for groups of up to 3 ** `group_levels` rows."""
    def grow(name: str, keys: str, levels: int) -> list[str]:
        by = f"PARTITION BY {keys}" if keys else ""
        out = []
        for j in range(levels):
            out.append(f"{name}n{j} AS MATERIALIZED (SELECT *, count(*) OVER ({by}) AS n FROM {name}{j})")
            cols = f"{keys}, " if keys else ""
            out.append(f"{name}{j + 1} AS MATERIALIZED (SELECT {cols}i // {FAN} AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}n{j} GROUP BY ALL)")
            run = f"PARTITION BY {cols}i // {FAN} ORDER BY i ROWS BETWEEN"
            side = "CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({}), '') ELSE '' END"
            out.append(f"{name}s{j} AS MATERIALIZED (SELECT {cols}i, n > 1 AS up, {side.format(run + ' UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {side.format(run + ' 1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {name}n{j})")
        return out

    def piece(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(piece(text if f == "text" else f) for f in LEAF_FIELDS) + ")"

    stripped = "replace(text, chr(10), '')"
    step = "CASE WHEN {s}.up THEN sha256({s}.b || f || {s}.a) ELSE f END AS f, p || {s}.b || {s}.a AS p"
    walk = [f"w0 AS (SELECT doc_id, x, k, i AS g, g AS u, leaf, tampered AS f, '' AS p FROM leaves)"]
    for j in range(group_levels):
        walk.append(f"w{j + 1} AS MATERIALIZED (SELECT doc_id, x, w.k, g // {FAN} AS g, u, leaf, {step.format(s='s')} FROM w{j} w JOIN ts{j} s ON s.k = w.k AND s.i = w.g)")
    for j in range(root_levels):
        walk.append(f"w{group_levels + j + 1} AS MATERIALIZED (SELECT doc_id, x, w.k, g, u // {FAN} AS u, leaf, {step.format(s='s')} FROM w{group_levels + j} w JOIN rs{j} s ON s.i = w.u)")
    ctes = [
        f"steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)",
        "crc AS (SELECT doc_id AS id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), steps)",
        f"hashed AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN c % 2 = 0 THEN {leaf(stripped)} ELSE {leaf('text')} END AS tampered FROM documents d LEFT JOIN crc ON id = doc_id)",
        "leaves AS MATERIALIZED (SELECT row_number() OVER () AS x, doc_id, leaf, tampered, (dense_rank() OVER (ORDER BY source NULLS FIRST) - 1) AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed)",
        "t0 AS (SELECT k, i, leaf AS h FROM leaves)", *grow("t", "k", group_levels),
        f"r0 AS (SELECT k AS i, h FROM t{group_levels})", *grow("r", "", root_levels), *walk,
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM w{group_levels + root_levels} w JOIN t{group_levels} t ON t.k = w.k, r{root_levels} r"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": _oracle()}
