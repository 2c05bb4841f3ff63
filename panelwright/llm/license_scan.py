"""License scans: templates with optional and replaceable regions, compiled into one token automaton.

Markup of a template: words; `<<opt>> ... <<end>>` around words that may be absent (nesting is allowed);
`<<var m-n>>` for m to n words of any kind. Everything outside such regions is mandatory and must be present word for
word. All templates share one automaton whose states are made deterministic as texts reach them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import FOLD, MARKS, binary_parts, id_and_text

#: Phrases and labels of the base report.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices this operator knows: label, template.
TEMPLATES = [
    ("apache-2", "licensed under <<opt>> the <<end>> apache license <<opt>> version <<end>> 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license <<var 0-20>> you may obtain a copy of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under <<opt>> a <<end>> <<opt>> creative commons <<end>> cc by nc <<opt>> sa <<end>> <<var 1-2>>"),
    ("cc-notice", "this work is licensed under <<opt>> a <<end>> creative commons attribution <<var 0-4>> license"),
    ("gpl-notice", "licensed under the gnu <<opt>> lesser <<end>> general public license <<opt>> version <<var 1-2>> <<end>>"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu <<opt>> lesser <<end>> general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<var 1-8>> and associated documentation files"),
    ("reserved-notice", "copyright <<opt>> c <<end>> <<var 1-10>> all rights reserved"),
]

_MARK = re.compile(r"<<\s*(opt|end|var)\s*(?:(\d+)\s*-\s*(\d+))?\s*>>|(\S+)")
ANY = None


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Gap:
    least: int
    most: int


@dataclass(frozen=True)
class Optional:
    parts: tuple


def parse(template: str) -> tuple:
    """Parts of a template: words, gaps and optional groups."""
    stack: list[list] = [[]]
    for mark, least, most, word in _MARK.findall(template):
        if mark == "opt":
            stack.append([])
        elif mark == "end":
            if len(stack) == 1:
                raise ValueError(f"<<end>> without <<opt>>: {template}")
            group = tuple(stack.pop())
            stack[-1].append(Optional(group))
        elif mark == "var":
            if not most or int(least) > int(most):
                raise ValueError(f"<<var m-n>> needs m <= n: {template}")
            stack[-1].append(Gap(int(least), int(most)))
        else:
            stack[-1].append(Word(word.lower()))
    if len(stack) != 1:
        raise ValueError(f"<<opt>> without <<end>>: {template}")
    if not any(isinstance(p, Word) for p in stack[0]) or isinstance(stack[0][0], Gap):
        raise ValueError(f"a template starts with words and has mandatory ones: {template}")
    return tuple(stack[0])


def mandatory_words(parts: tuple) -> int:
    return sum(isinstance(p, Word) for p in parts)


def as_regex(parts: tuple) -> str:
    """The same language over words that each end in one blank; used by the SQL twin."""
    out = ""
    for p in parts:
        if isinstance(p, Word):
            out += re.escape(p.text) + " "
        elif isinstance(p, Gap):
            out += f"(?:[^ ]+ ){{{p.least},{p.most}}}"
        else:
            out += f"(?:{as_regex(p.parts)})?"
    return out


class TokenAutomaton:
    """Automaton of all patterns; deterministic states are built on demand and kept."""

    def __init__(self, patterns: list[tuple]):
        self._moves: list[list[tuple[bytes | None, int]]] = []
        self._free: list[list[int]] = []
        self._ends: dict[int, int] = {}
        start = self._node()
        for number, parts in enumerate(patterns):
            first = self._node()
            self._free[start].append(first)
            self._ends[self._chain(parts, first)] = number
        self._sets: dict[frozenset[int], int] = {}
        self.accepts: list[tuple[int, ...]] = []
        self._known: list[frozenset[int]] = []
        self._next: list[dict[bytes, int]] = []
        self._other: list[int | None] = []
        self.start = self._state({start})
        self.first_words = frozenset(w for n in self._known[self.start] for w, _ in self._moves[n])

    def _node(self) -> int:
        self._moves.append([])
        self._free.append([])
        return len(self._moves) - 1

    def _chain(self, parts: tuple, at: int) -> int:
        for p in parts:
            if isinstance(p, Word):
                to = self._node()
                self._moves[at].append((p.text.encode(), to))
                at = to
            elif isinstance(p, Gap):
                done = self._node()
                for k in range(p.most):
                    if k >= p.least:
                        self._free[at].append(done)
                    to = self._node()
                    self._moves[at].append((ANY, to))
                    at = to
                self._free[at].append(done)
                at = done
            else:
                to = self._chain(p.parts, at)
                self._free[at].append(to)
                at = to
        return at

    def _state(self, nodes: set[int]) -> int:
        todo, closed = list(nodes), set(nodes)
        while todo:
            for n in self._free[todo.pop()]:
                if n not in closed:
                    closed.add(n)
                    todo.append(n)
        key = frozenset(closed)
        if key not in self._sets:
            self._sets[key] = len(self._known)
            self._known.append(key)
            self.accepts.append(tuple(sorted(self._ends[n] for n in key if n in self._ends)))
            self._next.append({})
            self._other.append(None)
        return self._sets[key]

    def step(self, state: int, word: bytes) -> int:
        """Next state, or -1 when nothing can match any more."""
        to = self._next[state].get(word)
        if to is not None:
            return to
        moves = [m for n in self._known[state] for m in self._moves[n]]
        if not any(w == word for w, _ in moves):  # such words are not kept: there is no end of them
            if self._other[state] is None:
                rest = {n for w, n in moves if w is ANY}
                self._other[state] = self._state(rest) if rest else -1
            return self._other[state]
        self._next[state][word] = to = self._state({n for w, n in moves if w == word or w is ANY})
        return to

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(pattern, first word, end) of every place a pattern starts at, each with its shortest end."""
        first, accepts = self.first_words, self.accepts
        for i in [i for i, w in enumerate(words) if w in first]:
            state, at, seen = self.start, i, set()
            while state >= 0 and at < len(words):
                state = self.step(state, words[at])
                at += 1
                if state >= 0:
                    for p in accepts[state]:
                        if p not in seen:
                            seen.add(p)
                            yield p, i, at


_KEEP = np.where(MARKS[FOLD], 32, FOLD).astype(np.uint8).tobytes()


def split_words(raw: bytes) -> list[bytes]:
    """Folded words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of one text."""
    return raw.translate(_KEEP).split()


MATCH_SCHEMA = "doc_id long, n_words long, matches array<struct<label:string, base:boolean, mandatory:int, first_word:long, end_word:long>>"


def license_matches(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, matches): every accepted notice of every whole text, with its words [first_word, end_word).

    Null and empty texts have no words and no matches; a null id, repeated rows and other columns of the table do not
    matter: there is one output row per input row. A map over the scan: no shuffle, nothing is kept across texts but
    the automaton, whose size depends on the templates alone.
    """
    named = [(label, parse(p), True) for p, label in (BASE if phrases is None else phrases).items()]
    named += [(label, parse(p), False) for label, p in (TEMPLATES if templates is None else templates)]
    info = [{"label": label, "base": base, "mandatory": mandatory_words(parts)} for label, parts, base in named]
    patterns = [parts for _, parts, _ in named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TokenAutomaton(patterns)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("mandatory", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            data, at = binary_parts(batch.column("text"))
            counts, found = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                words = split_words(data[a:b].tobytes())
                counts.append(len(words))
                found.append([info[p] | {"first_word": i, "end_word": end} for p, i, end in automaton.matches(words)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "matches"])

    return id_and_text(documents, key, text).mapInArrow(run, MATCH_SCHEMA)


def license_report(documents: DataFrame) -> DataFrame:
    """One row per document: counts and labels. Score: m / (m + 2) for the accepted notice with most mandatory words m, else 0."""
    base = F.filter("matches", lambda m: m["base"])
    where = F.transform(base, lambda m: m["first_word"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["mandatory"])), F.lit(0))
    return license_matches(documents).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(where).alias("first_word"), F.array_max(where).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), (most / (most + F.lit(2.0))).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def places(phrase: str) -> str:
        tokens = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(tokens, 1))
        return f"list_filter(range(greatest(len(w) - {len(tokens) - 1}, 0)), lambda i: {test})"

    base = [(f"len({places(p)})", places(p), label, len(p.split())) for p, label in BASE.items()]
    notices = [(f"regexp_matches(s, ' {as_regex(parse(p))}')", label, mandatory_words(parse(p))) for label, p in TEMPLATES]
    base_labels = ", ".join(f"CASE WHEN {n} > 0 THEN '{label}' END" for n, _, label, _ in base)
    all_labels = base_labels + ", " + ", ".join(f"CASE WHEN {t} THEN '{label}' END" for t, label, _ in notices)
    most = "greatest(0, " + ", ".join([f"CASE WHEN {n} > 0 THEN {m} ELSE 0 END" for n, _, _, m in base] + [f"CASE WHEN {t} THEN {m} ELSE 0 END" for t, _, m in notices]) + ")"
    where = "list_concat(" + ", list_concat(".join(x for _, x, _, _ in base[:-1]) + f", {base[-1][1]}" + ")" * (len(base) - 1)

    def joined(x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda x: x IS NOT NULL))), ',')"

    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS s, {where} AS p FROM t),
r AS (SELECT doc_id, w, p, {joined(base_labels)} AS base_labels, {joined(all_labels)} AS labels, {most} AS m FROM s)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word, base_labels, labels, m / (m + 2.0)::DOUBLE AS score FROM r
"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": _oracle()}
