import random

import pyarrow as pa
import pytest

from panelwright.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, MODEL, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SPECIAL = "<|endoftext|>"


def whole(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def texts_of(n, seed):
    rng = random.Random(seed)
    atoms = ["a", "Word", "don't", "'s", "'", "12", "3", ".", "...", ",", "!?", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", "　", " ", "é", "ü", "日本", "語", "\U0001f600", "́",
             SPECIAL, " " + SPECIAL, SPECIAL + " ", "<|end", "oftext|>", "~", "\x7f", "\x00", "/"]
    return ["".join(rng.choices(atoms, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path", [JSON, MODEL, WORD])
def test_counts_equal_whole_texts(path):
    texts = texts_of(1500 if path == JSON else 300, 5)
    counter = T.Counter(path, remembered=300)
    assert counter.cuts == (path == JSON)
    for group in (64, 1 << 20):
        assert T.count_column(pa.array(texts), counter, group).tolist() == whole(path, texts)
    assert counter.held <= 300 + T.SHORT


def test_long_texts_are_cut(monkeypatch):
    counter, asked = T.Counter(JSON), []
    inner = counter._lengths
    counter._lengths = lambda texts: asked.append(sum(map(len, texts))) or inner(texts)
    monkeypatch.setattr(T, "BATCH", 1000)
    text = " ".join(f"word{i} and\n\n{i}" for i in range(4000))
    assert T.count_column(pa.array([text, "x" * 5000, None, text]), counter).tolist() == [*whole(JSON, [text, "x" * 5000]), 0, whole(JSON, [text])[0]]
    assert len(asked) > 40 and sorted(asked)[-2] < 1100 and sum(asked) < len(text) + 5000  # each distinct piece once, one of them long


def test_edge_rows(spark):
    rows = [(1, "Hello world", "x"), (None, None, "x"), (2, "", "x"), (2, "", "x"), (3, f"a{SPECIAL}b", "x"), (4, "long text " * 50_000, "x")]
    got = sorted((tuple(r) for r in T.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), JSON).collect()), key=repr)
    want = sorted(((k, len((t or "").encode()), n) for (k, t, _), n in zip(rows, whole(JSON, [t or "" for _, t, _ in rows]))), key=repr)
    assert got == want
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), JSON).count() == 0
