import random
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import jaccard_join as J
from panelwright.llm.components import connected_components

FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLDED))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = r.choices(vocabulary, k=40)
    docs = []
    for i in range(n):
        kind = r.random()
        if kind < 0.55 and docs:
            words = r.choice(docs[: max(1, len(docs) // 4)])[1].split()  # chains of near copies of a few originals
            for _ in range(r.randint(0, 5)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 8, 9, 10, 11, 40, 120]))
            if r.random() < 0.4:
                words = shared + words
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 50), (4, 3, 70), (5, 3, 100)])
def test_components_against_brute_force(spark, seed, k, percent):
    docs = corpus(seed)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, component_id int").repartition(4)
    got = J.near_duplicates(d, k=k, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(docs, k, percent)


def test_adaptive_prefixes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "VERIFY_COST", 1e9)  # every document asks for the most matches
    monkeypatch.setattr(J, "SALT_PAIRS", 3)
    docs = corpus(9)
    assert sorted(map(tuple, J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=80).collect())) == brute(docs, 3, 80)


def test_edge_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (9, None), (8, ""), (None, None), (None, "alone here"), (7, "two words"), (6, "two words")]
    got = sorted(map(repr, map(tuple, J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, [(5, 4, 3), (5, 4, 3), (3, 4, 3), (None, 4, 3), (9, 0, 9), (8, 0, 8), (None, 0, None), (None, 1, None), (7, 1, 6), (6, 1, 6)]))
    kept = J.one_per_group(spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, component_id string"))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [3, None, 9, 8, None, None, 6]))
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 500), (900, 700), (None, 3)], "a long, b long"))
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 700, 700: 700}
