import gc
import random
import time
import weakref

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import toxicity as X
from panelwright.llm import url_filter as U
from panelwright.llm import vp_search as V


def exact(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, float))
    items, out = list(good.items()), []
    for (q, _), a in items:
        if q in queries:
            scored = sorted((-V.running_dot(a[None], b[None])[0, 0] / (V.norms(a[None])[0] * V.norms(b[None])[0]), i) for (i, _), b in items if i != q and len(b) == len(a))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_exact_search_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(300)] + [(i, [1.0] * 6) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [None] + [1.0] * 5), (504, [float("nan")] * 6), (505, [float("inf")] * 6), (None, [1.0] * 6), (0, rows[0][1]), (600, [1.0, 2.0]), (650, [2.0, 1.0])]
    d = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = V.nearest(d, F.col("vec_id") % 50 == 0, k=5, shard=100)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == exact(rows, set(range(0, 700, 50)), 5)
    assert V.nearest(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_relaxed_search_keeps_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * r.normal(size=16)).tolist()) for i in range(1500)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {x[:1] + x[2:3] for x in exact(rows, set(range(0, 1500, 100)), 5)}
    got = {(x["query_id"], x["vec_id"]) for x in V.nearest(d, F.col("vec_id") % 100 == 0, factor=0.7, shard=500).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_tree_of_equal_rows_is_a_leaf():
    tree = V.VantageTree.build(np.arange(500), np.ones((500, 3)))
    scores, ids, found = tree.search(np.array([3]), np.ones((1, 3)), 5, 1.0)
    assert ids[0].tolist() == [0, 1, 2, 4, 5] and found.all()


def test_huge_and_tiny_vectors_are_searched(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 4)) * 10.0 ** r.choice([-200, 0, 200], size=(60, 1))
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.abs(v).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = V.nearest(df, "vec_id % 10 = 0", 3, shard=16).collect()
    assert len(got) == 18
    for g in got:
        others = sorted(((unit[g["query_id"]] @ unit[i], i) for i in range(60) if i != g["query_id"]), reverse=True)
        assert g["vec_id"] == others[g["rank"] - 1][1] and abs(g["score"] - others[g["rank"] - 1][0]) < 1e-12


def test_tiles_of_queries_and_trees_find_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BYTES", 1000, raising=False)
    monkeypatch.setattr(V, "TREE_BYTES", 6000, raising=False)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=4 + 3 * (i % 5 == 0)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(0, 400, 3)] + [(805 + i, [2 * x for x in rows[i][1]]) for i in range(0, 400, 40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = V.nearest(d, F.col("vec_id") % 10 == 0, k=5, shard=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == exact(rows, set(range(0, 1000, 10)), 5)


def test_tiles_are_bounded_and_few():
    assert V.tiling(0, 0, 0, 0, 0, 32) == (1, 1)
    assert V.tiling(13, 51_282, 51_282 * 64, 1_026, 1_026 * 64, 32) == (13, 1)
    for copies in (1, 10, 100):
        trees, rows, queries = 150 * copies, 615_384 * copies, 12_312 * copies
        tree_groups, query_groups = V.tiling(trees, rows, rows * 64, queries, queries * 64, 32)
        assert queries * 512 / query_groups <= V.QUERY_BYTES and rows * 512 / tree_groups <= V.TREE_BYTES
        assert rows * queries / tree_groups / query_groups <= V.PAIRS and tree_groups * query_groups >= 32
        assert queries * tree_groups + rows * query_groups < (0.5 if copies == 1 else 0.25) * (queries * trees + rows)  # every query sent to every tree


def test_trees_share_the_bounds_of_queries(monkeypatch):
    scored, score = [], V.Best.score
    monkeypatch.setattr(V.Best, "score", lambda self, tree, i, j: (scored.append((tree, len(i))), score(self, tree, i, j)))
    r = np.random.default_rng(5)
    v = r.normal(size=(4000, 16))
    best = V.Best(np.arange(0, 4000, 50), v[::50], 5)
    trees = [V.VantageTree.build(np.arange(a, a + 1000), v[a : a + 1000]) for a in range(0, 4000, 1000)]
    for tree in trees:
        best.search(tree, 1.0)
    first, *_, last = (sum(n for t, n in scored if t is tree) for tree in trees)
    assert last * 4 < first < 80 * 1000 / 4
    s = V.running_dot(v[::50], v) / (V.norms(v[::50])[:, None] * V.norms(v))
    s[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    assert (best.found == np.argsort(-s, axis=1)[:, :5]).all() and (best.scores == -np.sort(-s, axis=1)[:, :5]).all()


def test_a_tree_is_freed_once_it_was_searched():
    v = np.random.default_rng(6).normal(size=(500, 4))
    gc.disable()
    try:
        tree = V.VantageTree.build(np.arange(500), v)
        seen = weakref.ref(tree)
        tree.search(np.arange(9), v[:9], 5, 1.0)
        del tree
        assert seen() is None
    finally:
        gc.enable()


def test_urls(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "a.net/en/x"), ("block", "é.org/ü")]
    urls = ["http://a.example.NET/en/1", "https://example.net/de", "x://net/", "http://net", "http://net?/", "http://internet/", "nonsense", None, "", "http://a.net/en/xyz#q/", "://é.org/üa", "http://" + "s." * 300 + "net/", "http://example.net/en/", "ftp://u@h:8/p?q"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in U.judge(pages, [U.digest_list(spark, rules)]).collect()}

    def brute(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(e), e, a) for a, e in rules if (host == e.partition("/")[0] or host.endswith("." + e.partition("/")[0])) and path.startswith("/" + e.partition("/")[2])]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    assert [tuple(got[i])[1:] for i in range(len(urls))] == [brute(u) for u in urls]
    assert U.judge(pages.limit(0), [U.digest_list(spark, [])]).count() == 0


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    files = U.write_digest_list(U.literal_entries(spark, [("block", "a.com/"), ("allow", "b.com/")]).coalesce(1))
    listed = U.DigestList(files)
    monkeypatch.setattr(U, "_digest", lambda e: 7)
    body = b"ba.com/ab.com/"
    listed.firsts, listed.parts = np.array([7], np.uint64), [(np.full(2, 7, np.uint64), np.array([7, 14], np.uint64), np.frombuffer(body, np.uint8))]
    assert listed.find(["b.com/", "c.com/", "a.com/"]) == ["allow", None, "block"]
    assert sorted(listed.entries()) == ["a.com/", "b.com/"]
    assert sorted(U.DigestList(files).entries()) == ["a.com/", "b.com/"]


def test_a_long_list_in_ranges(spark):
    entries = [("block" if i % 3 else "allow", f"h{i}.example.com/{'d/' * (i % 4)}") for i in range(3000)]
    files = U.write_digest_list(U.literal_entries(spark, [*entries, ("allow", "h1.example.com/d/"), ("block", None)]).repartition(4))
    listed = U.DigestList(files)
    assert sorted(listed.entries()) == sorted(e for _, e in entries) and files.shapes == [(3, n) for n in (1, 3, 5, 7)]
    assert all(len(d) and (np.diff(d) > 0).all() for d, _, _ in listed.parts)
    assert listed.find([e for _, e in entries]) == [a for a, _ in entries]
    assert listed.find([e + "x" for _, e in entries]) == [None] * len(entries)


def test_hosts_of_many_dots_cost_nothing():
    many = "." * 1_000_000 + "a.net"
    assert U.candidates(many, "/x", [(1, 1), (2, 1), (2, 2), (2, 3)]) == ["net/", "a.net/", "a.net/x"]
    assert U.candidates("net", "/", [(1, 1), (2, 1)]) == ["net/"] and U.candidates("", "/", [(1, 1)]) == U.candidates("a", "", [(1, 1)]) == U.candidates("a", "/", []) == []


def test_sections_of_tracking_links(spark):
    urls = ["http://A.b/x/1?ref=1", "http://a.b/x/2?q=1&utm_id=3", "http://a.b/x/3", "http://a.b/y/1?ref=1", "http://c.d/x/1?href=1", "http://c.d/x/2?q#ref=", "http://c.d/x/3", "http://e.f?ref=1", None, "x?ref=1"]
    pages = spark.createDataFrame([(u, 1) for u in urls], "url string, host int")
    assert [tuple(r) for r in U.tracked_sections(pages).collect()] == [("a.b/x/", "block")]
    assert U.tracked_sections(pages.limit(0)).count() == 0


def test_folding_and_exceptions():
    m = X.Matcher(X.Model({"idiot": 2.0, "idi*": 1.0, "trash": 3.0}))
    assert m.weight("You 1d10t! іdіоt; IDIOT") == (4, 3, 6.0)
    assert m.weight("an idiom in the trash can") == (6, 1, 1.0)
    assert m.weight("trash trashy trash canned") == (4, 2, 6.0)
    assert m.weight(None) == (0, 0, 0.0) and m.weight(" !! ") == (0, 0, 0.0)
    assert X.Matcher(X.Model({}, ())).weight("idiot")[1:] == (0, 0.0)


def plain_weight(model, text):
    """(words, matched words, weight) word by word, without an automaton."""
    words = X.fold(text)
    covered = set()
    for phrase in map(X.fold, model.exceptions):
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                covered |= set(range(i, i + len(phrase)))
    found = []
    for i, word in enumerate(words):
        fits = [w for e, w in model.entries.items() if (word.startswith(e[:-1]) if e.endswith("*") else word == e)]
        if fits and i not in covered:
            found.append(max(fits))
    return len(words), len(found), float(sum(found))


def test_scores_against_brute_force(spark):
    model = X.Model({"trash": 3.0, "tra*": 1.5, "can": 0.5, "bin": 1.0, "idiot": 2.0, "id*": 2.5}, ("trash can", "can trash", "trash bin trash", "can can"), (-1.0, 1.5, 0.25))
    r = random.Random(8)
    texts = [" ".join(r.choice(["trash", "can", "bin", "tr4sh", "idiot", "IDLE", "fine", "tram", "trash!", "can,"]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    rows = [*enumerate(texts), (7, texts[7]), (None, "trash"), (900, None), (901, "")]
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, weight string").repartition(4)
    got = sorted((g["doc_id"] if g["doc_id"] is not None else -1, g["n_words"], g["n_matched"], g["weight"], round(g["score"], 12), g["predicted"]) for g in X.score(docs, model).collect())
    want = []
    for i, t in rows:
        n, k, w = plain_weight(model, t)
        p = 1 / (1 + np.exp(1.0 - 1.5 * np.log1p(w) - 0.25 * np.log1p(100 * w / max(n, 1))))
        want.append((i if i is not None else -1, n, k, w, round(float(p), 12), int(p >= 0.5)))
    assert got == sorted(want)
    assert X.score(docs.limit(0), model).collect() == []


def test_many_exceptions_take_linear_time():
    m = X.Matcher(X.Model({"trash": 3.0}))
    began = time.perf_counter()
    assert m.weight("trash can trash " * 200_000) == (600_000, 200_000, 600_000.0)
    assert time.perf_counter() - began < 20


def test_copies_share_a_weight_and_keep_their_labels(spark):
    """A toxic text made from a clean one shares its smallest triple: both stay, and copies of one label count as one."""
    base = " ".join(f"w{i}" for i in range(60))
    labels = [(i, 0) for i in range(40)] + [(i, 1) for i in range(40, 44)]
    docs = [(i, base) for i in range(40)] + [(i, base + " grobble") for i in range(40, 44)]
    rows = X.training_rows(spark.createDataFrame(docs + docs[:3], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) > 30
    for toxic in (0, 1):
        mine = [r["share"] for r in rows if r["toxic"] == toxic]
        assert mine and all(x == round(X.WHOLE / len(mine)) for x in mine)


def corpus(n=900):
    r, rows, labels = random.Random(6), [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [r.choice("abcdefgh") + r.choice("klmnop") * r.randint(1, 4) + r.choice("xyz") for _ in range(r.randint(20, 200))]
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randint(0, len(words)), "grobble" + r.choice("abcd"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_accuracy_on_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*x, 0.0) for x in rows] + [(None, None, 0.0), (5000, "", 0.0), (5001, "", 0.0)], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame([*labels, (0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = X.learn(docs, marks)
    got = X.score(docs, model).withColumn("held_out", X.held_out("doc_id")).collect()
    assert len(got) == len(rows) + 3 and all(0 <= g["score"] <= 1 for g in got)
    truth = dict(labels)
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert len(held) > 100 and all(g["predicted"] == truth[g["doc_id"]] for g in held)
    assert all(g["predicted"] == 0 for g in got if g["doc_id"] not in truth)
    kept = X.remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(g["predicted"] == 0 for g in got)


def test_without_labels_the_seeds_hold(spark):
    docs = spark.createDataFrame([(1, "you stupid worthless idiot"), (2, "a fine day")], "doc_id long, text string")
    model = X.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in X.score(docs, model).orderBy("doc_id").collect()] == [1, 0]
