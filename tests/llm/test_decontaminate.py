import hashlib
import random
import re

from panelwright.llm import decontaminate as D

FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLDED))


def brute(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - width + 1, 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def data():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "X-Y"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([2, 5, 13, 30])))) for i in range(12)] + [(12, ""), (13, None), (None, "w1 w2 w3"), (3, "w1")]
    docs = []
    for d in range(40):
        t = r.choices(vocabulary, k=r.randint(0, 300))
        for _ in range(r.randint(0, 2)):
            a = r.randint(0, len(t))
            t[a:a] = (r.choice(items[:12])[1]).upper().split() * r.randint(1, 2)
        docs.append((d, "; ".join(t)))
    return docs + [(100, None), (101, ""), (None, "w1"), (5, docs[5][1])], items


def test_against_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(d, b).drop("hit_spans")
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(docs, items)
    unique = [x for x in docs if x[0] is not None][:-1]
    blocks = D.contamination(spark.createDataFrame(unique, "doc_id long, text string"), b, max_windows=40).drop("hit_spans")
    assert sorted(map(repr, map(tuple, blocks.collect()))) == brute(unique, items)


def test_large_benchmarks_keep_null_and_repeated_ids(spark):
    docs, items = data()
    docs += [(None, items[3][1]), (None, items[7][1] + " w1"), (None, None), (5, items[9][1]), (6, docs[6][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (1, 40, 10_000):
        got = D.contamination(d, b, max_windows=most)
        assert got.columns[-1] == "hit_spans" and sorted(map(repr, map(tuple, got.drop("hit_spans").collect()))) == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(d, b.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert D.contamination(d.limit(0), b).count() == 0


def test_removal(spark):
    item = " ".join(f"q{i}" for i in range(15))
    rows = [(1, f"Start. {item}, end!", "x"), (2, "clean text", "y"), (3, None, "z"), (None, item, "n"), (4, item + " a" * 400, "w")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string, contaminated string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = D.remove_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["contaminated"] for r in kept.collect()) == ["n", "w", "y", "z"]
    cut = {r["doc_id"]: r["text"] for r in D.remove_spans(d.filter("doc_id is not null"), b).collect()}
    assert cut[1] == "Start. , end!" and cut[2] == "clean text" and cut[3] is None and cut[4].split() == ["a"] * 400
