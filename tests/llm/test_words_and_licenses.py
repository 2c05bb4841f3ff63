import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import license_scan as L
from panelwright.llm import words as W

FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", "   ", "One", "É a\x0bB c d", "x" * 5000, "a b a b a b", "CC BY, cc-by", "ß\tü\nÄ", "é" * 3]


def test_words_match_the_patterns():
    for table, pattern in ((W.SPACES, r"[^\x20\x09-\x0D]+"), (W.MARKS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for piece in W.scan(pa.array(TEXTS), table):
            got += [[piece.get(i).decode() for i in range(piece.bounds[t], piece.bounds[t + 1])] for t in range(piece.texts)]
        assert got == [re.findall(pattern, (t or "").translate(FOLDED)) for t in TEXTS]


def test_hashes_depend_on_the_word_alone(monkeypatch):
    monkeypatch.setattr(W, "PIECE", 64)
    seen = {}
    for piece in W.scan(pa.array(TEXTS * 3), W.SPACES):
        for i in range(len(piece.hashes)):
            seen.setdefault(piece.get(i), set()).add(int(piece.hashes[i]))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def test_runs_stay_inside_texts():
    (piece,) = W.scan(pa.array(["a b c", "a b", None, "b c d e"]), W.SPACES)
    at, hashes = piece.runs(2)
    assert at.tolist() == [0, 1, 3, 5, 6, 7] and hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4


def test_template_language_equals_its_regex():
    templates = ["a <<opt>> b <<opt>> c <<end>> <<end>> d", "b <<var 0-2>> c", "a <<var 1-3>>", "d <<opt>> <<var 1-1>> <<end>> a b"]
    parsed = [L.parse(t) for t in templates]
    automaton, random_ = L.TokenAutomaton(parsed), random.Random(5)
    for _ in range(400):
        words = [random_.choice("abcd").encode() for _ in range(random_.randint(0, 9))]
        found = {p for p, _, _ in automaton.matches(words)}
        text = " " + b" ".join(words).decode() + " "
        assert found == {i for i, p in enumerate(parsed) if re.search(" " + L.as_regex(p), text)}


@pytest.mark.parametrize("bad", ["<<opt>> a", "a <<end>>", "<<var 1-2>> a", "<<opt>> a <<end>>", "a <<var 3-1>>"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        L.parse(bad)


def test_edge_rows(spark):
    rows = [(1, "All rights reserved. ALL RIGHTS RESERVED", 9.0), (None, None, 1.0), (2, "", 2.0), (2, "", 2.0), (3, "cc by " * 3000, 0.0), (4, "released under the MIT licence", 0.0)]
    got = sorted(L.license_report(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect(), key=str)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and by[1]["n_base"] == 2 and (by[1]["first_word"], by[1]["last_word"]) == (0, 3) and by[1]["labels"] == "reserved"
    assert by[None]["n_words"] == 0 and by[None]["first_word"] is None and by[2]["labels"] == "" and by[2]["score"] == 0.0
    assert by[3]["n_base"] == 3000 and by[4]["labels"] == ""
    assert L.license_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_are_mask():
    assert W.spans_to_mask(np.array([1, 2]), np.array([2, 2]), 5).tolist() == [False, True, True, True, False]
