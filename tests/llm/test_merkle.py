import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelwright.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def tree(nodes):
    """(root, siblings (before, after) per node and level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            start = k // 3 * 3
            paths[i].append(("".join(nodes[start:k]), "".join(nodes[k + 1 : start + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        mine = sorted(((r, leaf(r, r[1])) for r in groups[s]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made.append((mine, *tree([x for _, x in mine])))
    root, upper = tree([m[1] for m in made])
    out = []
    for (mine, subroot, paths), beyond in zip(made, upper):
        for (r, own), path in zip(mine, paths):
            path = path + beyond
            strip = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "")) if strip else own
            for before, after in path:
                node = h(before, node, after)
            out.append((r[0], own, subroot, root, h(*[b + a for b, a in path]), node, node == root))
    return sorted(map(repr, out))


def rows_of(counts):
    rng, rows = random.Random(4), []
    for source, n in counts:
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "\n", "plain", "é\n\nü", "x" * 500])
            rows.append((rng.randint(-50, 5000), text, rng.choice([None, "", "en"]), source, rng.choice([None, 0, 17]), "clash", 1))
    return rows + [(None, "a\n", None, "s1", None, "", 0)] * 2 + rows[:2]


@pytest.mark.parametrize("height", [1, 5])
@pytest.mark.parametrize("counts", [[("s1", 1)], [("s1", 83), (None, 28), ("é", 4), ("", 9), ("z", 10), ("Z", 1)]])
def test_against_brute_force(spark, height, counts):
    rows = rows_of(counts)
    assert sorted(map(repr, map(tuple, M.tamper_report(spark.createDataFrame(rows, SCHEMA).repartition(5), height).collect()))) == brute(rows)


def test_one_group_and_many(spark):
    same = spark.range(731).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    apart = same.withColumn("source", F.col("doc_id").cast("string"))
    for df in (same, apart):
        got = [tuple(r) for r in M.merkle_manifest(df, height=2).select("doc_id", "root", M.folded(F.col("leaf"), F.col("path"))).collect()]
        assert len(got) == 731 and {r[1] for r in got} == {r[2] for r in got} and len({r[1] for r in got}) == 1


def test_empty_table_and_changed_rows(spark):
    assert M.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, f"text {i}", "en", f"s{i % 2}", 6, "", 0) for i in range(20)]
    manifest = M.merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    other = [(99 if i == 4 else i, "changed" if i == 9 else t, *rest) for i, t, *rest in rows]
    found = {r["doc_id"]: r["verified"] for r in M.check_rows(spark.createDataFrame(other, SCHEMA), manifest).collect()}
    assert [k for k, ok in found.items() if not ok] in ([9, 99], [99, 9]) and len(found) == 20
