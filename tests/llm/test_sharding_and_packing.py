import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import jump_shards as J
from panelwright.llm import length_packing as P
from panelwright.llm.ranking import number_within


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_against_the_published_loop(spark, monkeypatch):
    keys = [0, 1, 2, -1, -(2**63), 2**63 - 1, *random.Random(1).sample(range(2**62), 200)]
    d = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 1000):
        assert [r[0] for r in d.select(J.jump_shard(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]
    monkeypatch.setattr(J, "JUMPS", 2)  # the second round takes over
    assert [r[0] for r in d.select(J.jump_shard(F.col("k"), 1000)).collect()] == [jump(k, 1000) for k in keys]


def test_growth_moves_only_into_the_new_shard(spark):
    got = spark.range(20000).select(J.jump_shard(F.col("id"), 40).alias("a"), J.jump_shard(F.col("id"), 41).alias("b"))
    moved = got.filter("a <> b")
    assert moved.filter("b <> 40").count() == 0 and 300 < moved.count() < 700
    sizes = [r["count"] for r in got.groupBy("a").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1.25 * 500 and min(sizes) > 0.75 * 500


def test_slots_are_gapless(spark):
    rows = [(i % 50 if i % 3 else 7, "é" * (i % 5), 1) for i in range(300)] + [(None, None, 2), (None, "", 3)]
    got = J.jump_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5), 4)
    by = {}
    for r in got.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {r["size"] for r in got.filter("doc_id is null").collect()}
    assert sizes == {16}
    assert J.jump_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_number_within_orders(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
    by = {}
    for r in number_within(d, ["g"], ["v"], "n").collect():
        by.setdefault(r["g"], []).append((r["n"], r["v"]))
    for rows in by.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows))) and [v for _, v in rows] == sorted(v for _, v in rows)


def padding(lengths, counts, bounds):
    at = np.searchsorted(bounds, lengths)
    return int(sum((bounds[i] - x) * c for i, x, c in zip(at, lengths, counts)))


def test_bounds_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 8)
        lengths, counts = np.array(r.sample(range(0, 60), n)), np.array([r.randint(1, 50) for _ in range(n)])
        for k in (1, 2, 3, 9):
            best = min(padding(np.sort(lengths), counts[np.argsort(lengths)], sorted({*c, max(lengths)})) for m in range(min(k, n)) for c in itertools.combinations(lengths.tolist(), m))
            got = P.best_bounds(lengths, counts, k)
            assert got == sorted(got) and len(got) <= k and got[-1] == max(lengths)
            assert padding(np.sort(lengths), counts[np.argsort(lengths)], got) == best


def test_batches_respect_the_budget(spark):
    rows = [(i if i % 4 else 8, "w " * ((i * 7) % 90), "x") for i in range(400)] + [(None, None, "y"), (500, "", "z"), (501, "w " * 5000, "long")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, batch string").repartition(6), buckets=4, budget=256).collect()
    assert len(got) == len(rows) and all(r["n_tokens"] <= r["bound"] for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), members in batches.items():
        assert len(members) == 1 or members[0]["bound"] * len(members) <= 256
        assert sorted(m["slot"] for m in members) == list(range(len(members))) and len({m["bound"] for m in members}) == 1
    lone = next(r for r in got if r["doc_id"] is None)
    assert lone["n_tokens"] == 1 and len({r["bucket"] for r in got}) <= 4
    full = [len(v) for (k, b), v in batches.items() if (k, b + 1) in batches]
    assert all(n == max(1, 256 // batches[k][0]["bound"]) for k, n in ((k, len(batches[k])) for k in batches if (k[0], k[1] + 1) in batches)) and full
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r["n_tokens"] for r in P.pack(spark.createDataFrame([(1, None)], "doc_id long, n int"), length="n").collect()] == [0]
