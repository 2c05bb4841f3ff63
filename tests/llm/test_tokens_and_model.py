import collections
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from panelwright.llm import kneser_ney as K
from panelwright.llm import token_planes as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(bits):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert np.array_equal(T.from_planes(T.to_planes(ids, bits), n, bits), ids)


def test_memory_of_stretches_is_bounded_in_bytes():
    encoder = T.Encoder(PATH, remembered=100_000)
    encoder.encode([(" ".join(f"word{i}{j}" for j in range(50)) + " " + "x" * 5000 + f"{i}").encode() for i in range(200)])
    assert encoder.held <= 100_000 + 50 * 400 and max(map(len, [*encoder, *encoder.old])) <= T.SHORT


def test_remembered_stretches_give_the_library_ids():
    from tokenizers import Tokenizer

    texts = ["The thing, is it's. X,", "ÉTÉ e\u0301 été", "a\u00a0b \u2003c\x1cd", "l'été, 12,5 & ... don't", "", "İstanbul ΣΑΣ", "<|endoftext|> x", "tab\tnew\nline", "word" * 300, "a.b,c. D.E,"]
    encoder, library = T.Encoder(PATH, remembered=5), Tokenizer.from_file(PATH)
    for _ in range(3):
        got = encoder.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_capitals_before_marks_give_the_library_ids():
    from tokenizers import Tokenizer

    marks = [chr(c) for c in range(0x80, 0x3100) if unicodedata.combining(chr(c))] + ["\u00a0", "\u00c9", "\u2003"]
    texts = [f"x{c}{m}y {c}{m}, A{c}{m}." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks]
    texts += ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "H\u0301\u0331", "CAF\u00c9 J\u030cA'S", "<|ENDOFTEXT|> x", "A<|EndOfText|>"]
    got = T.Encoder(PATH).encode([t.encode() for t in texts])
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, e in zip(texts, got, expected) if np.frombuffer(g, "<u4").tolist() != e] == []


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_file_round_trip(spark, tmp_path, block):
    from tokenizers import Tokenizer

    r = random.Random(block)
    rows = [(i, " ".join(r.choices(["alpha", "beta,", "Gamma", "été"], k=r.randint(0, 40))), 0) for i in range(60)] + [(7, "again", 0), (7, "again", 0), (None, None, 1), (60, "", 1)]
    T.write_token_planes(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4), str(tmp_path / "d"), PATH, block=block, bits=block != 64)
    library = Tokenizer.from_file(PATH)
    got = sorted(T.read_documents(spark, str(tmp_path / "d")).collect(), key=lambda x: x["start"])
    codes = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    assert sorted(map(repr, ((g["doc_id"], np.frombuffer(g["ids"], "<u4").tolist()) for g in got))) == sorted(map(repr, ((d, codes[d, t]) for d, t, _ in rows)))
    assert [g["doc_id"] for g in got] == sorted((g["doc_id"] for g in got), key=lambda x: -1 if x is None else x)
    assert [g["start"] for g in got] == [0, *np.cumsum([g["n_tokens"] for g in got])[:-1].tolist()]
    every = np.concatenate([np.frombuffer(g["ids"], "<u4") for g in got])
    for a, b in ((0, 5), (3, 90), (len(every) - 4, len(every)), (0, len(every))):
        assert np.array_equal(T.read_range(spark, str(tmp_path / "d"), a, b), every[a:b])


def test_empty_dataset(spark, tmp_path):
    T.write_token_planes(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert T.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_packed_runs():
    keys = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    counts = np.array([1, 2**40, 3, 4], np.uint64)
    assert all(np.array_equal(x, y) for x, y in zip(K.unpack(*K.pack(keys, counts)), (keys, counts)))
    merged = K.merge([(keys, counts), (keys[1:3], counts[:2])])
    assert merged[0].tolist() == keys.tolist() and merged[1].tolist() == [1, 2**40 + 1, 3 + 2**40, 4]


def brute_model(docs):
    c = collections.Counter(w for t in docs for w in t)
    pairs = collections.Counter(x for t in docs for x in zip([None, *t], t))
    after, before = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (p, w), n in pairs.items():
        after[p][0] += n
        after[p][min(n, 3)] += 1
        before[w] += 1
    d2, d1 = (K.discounts([sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, before))
    total, v = sum(before.values()), len(c)

    def cut(n, d):
        return n - d[min(n, 3) - 1] if n else 0.0

    def low(w):
        return cut(before[w], d1) / total + sum(d1[min(n, 3) - 1] for n in before.values()) / total / (v + 1) if total else 1.0 / (v + 1)

    def p(a, w):
        s = after.get(a)
        return low(w) if s is None else cut(pairs[a, w], d2) / s[0] + (d2[0] * s[1] + d2[1] * s[2] + d2[2] * s[3]) / s[0] * low(w)

    return c, p


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLDED)), "\x00"]


def test_model_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(vocabulary, weights=range(1, 31), k=r.randint(0, 60))), i) for i in range(80)] + [(200, "the " * 2000, 0), (201, "", 0), (202, None, 0), (None, "W1 w2", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int").repartition(3)
    held = {x[0] for x in docs if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 7 == 2}
    model = K.train(d.filter(~K.held_out()))
    c, p = brute_model([tokens(t) for i, t, _ in docs if i not in held])
    n, v = sum(c.values()), len(c)
    assert model.tokens == n and model.vocabulary == v
    new = docs + [(300, "unseen words w1 unseen", 0)]
    got = {x["doc_id"]: x for x in K.score(spark.createDataFrame(new, "doc_id long, text string, score int"), model).collect()}
    assert len(got) == len(new)
    for i, t, _ in new:
        t = tokens(t)
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(w in c for w in t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-8)
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([None, *t], t)), abs=1e-8)
    for a in (None, "w3", "the"):
        assert sum(p(a, w) for w in c) + p(a, "unseen") == pytest.approx(1.0)


def test_small_parts_give_the_same_scores(spark):
    r = random.Random(5)
    rows = [(i % 40, " ".join(f"w{int(r.expovariate(0.05))}" for _ in range(r.randint(0, 80)))) for i in range(90)] + [(1000, "a b " * 300_000), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few, many = K.train(d), K.train(d, part_bytes=60_000)
    many.mapped = 5
    assert few.parts == int(spark.conf.get("spark.sql.shuffle.partitions")) < many.parts == -(-sum(len(t or "") for _, t in rows) // 60_000)
    assert (few.tokens, few.d1, few.d2, few.continuations) == (many.tokens, many.d1, many.d2, many.continuations)

    def scores(model):
        return sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_tokens"], x["n_known"], round(x["base_score"], 6), round(x["score"], 6)) for x in K.score(d, model).collect())

    assert scores(few) == scores(many) and len(scores(few)) == len(rows)
    assert K.score(d.limit(0), few).count() == 0


def test_context_sums_beyond_32_bits(tmp_path):
    c = K.Constants(str(tmp_path), 1, [2], 0)
    for name, array in {"bigrams.0": np.array([1], np.uint64), "seen.0": np.array([255], np.uint8), "often.0": np.array([0, 2**33], np.uint64), "contexts.0": np.array([0], np.uint64), "totals.0": np.array([2**33], np.uint64), "kinds.0": np.array([0, 0, 1], np.uint32)}.items():
        K.save(str(tmp_path), name, array)
    n, sums = K.Arrays(c).bigrams(np.array([0, 0], np.uint64), np.array([0, 1], np.uint64))
    assert n.tolist() == [0, 2**33] and sums.tolist() == [[2**33, 0, 0, 1]] * 2


def test_model_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = K.score(d, K.train(d.limit(0))).collect()
    assert (row["n_tokens"], row["n_known"], row["score"], row["base_score"]) == (3, 0, 0.0, 0.0)
