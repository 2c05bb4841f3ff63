import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import importance_sampling as I
from panelwright.llm.words import MARKS, scan

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORDS.findall((text or "").translate(FOLDED))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(documents, target, buckets, percent, least):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, texts in ((s, [d[1] for d in documents]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                side[bucket(f, buckets)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for key, text in documents:
        n, fs = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f, buckets)] for f in fs)
        out.append([key, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = i
    return sorted(map(repr, map(tuple, out)))


def test_joined_crcs():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 300, 70_000])) for _ in range(60)]
    left = np.array([zlib.crc32(p) for p in parts], np.uint32)
    right, lengths = np.roll(left, 1), np.array([len(p) for p in [parts[-1], *parts[:-1]]])
    assert I.joined(left, right, lengths).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(parts, [parts[-1], *parts[:-1]])]


@pytest.mark.parametrize("most", [3, 40, 150_000])
def test_payloads_do_not_depend_on_what_is_remembered(most, monkeypatch):
    monkeypatch.setattr("panelwright.llm.words.PIECE", 400)
    d, rng = I.WordDictionary(most, 6), random.Random(2)
    d._learn()
    texts = [None, "", " ,; ", "é ß x1", "y" * 900] + [" ".join(rng.choice(["ab", "a", "ü1", "longer than", "Ab,", "b\x00c"]) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    for _ in range(3):
        for words in scan(pa.array(texts), MARKS, hashed=False):
            crc, lengths = d.payloads(words)
            own = [words.get(i) for i in range(len(words.starts))]
            assert crc.tolist() == [zlib.crc32(w) for w in own] and lengths.tolist() == [len(w) for w in own]
        d._learn()
        assert 0 < len(d.known) <= most


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "Of", "é", "x9", "long" * 30, "in", "to"]
    documents = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    documents += [(7, documents[7][1]), (7, documents[7][1]), (None, "a b " * 15), (None, None), (900, ""), (901, None), (902, "z" * 200_000), (903, "of the " * 4000)]
    target = ["the of the x9", None, "", "é é é in"]
    for least, percent in ((20, 5), (0, 100)):
        got = I.importance_resample(
            spark.createDataFrame([(k, t, "clash", 1) for k, t in documents], "doc_id long, text string, rank string, bucket int"),
            spark.createDataFrame([(t,) for t in target], "text string"), percent, least, buckets=50,
        )
        assert sorted(map(repr, map(tuple, got.collect()))) == brute(documents, target, 50, percent, least)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert I.importance_resample(none, some).collect() == []
    (row,) = I.importance_resample(some, none).collect()
    assert (row["n_features"], row["rank"]) == (6, None)
