"""Operator 1: licence phrases, and licence templates matched by token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from estatelens.llm.common import ASCII_LOWER, ASCII_UPPER, documents, per_batch, read, utf8

# Phrases and their labels.
PHRASES: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Templates and their labels. <<beginOptional>> ... <<endOptional>> may be left out,
# <<var;name;least-most>> stands for any words, so many of them.
TEMPLATES: list[tuple[str, str]] = [
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
                 "<<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
                  "creative commons attribution <<beginOptional>>4.0<<endOptional>> international <<beginOptional>>public<<endOptional>> license"),
    ("gpl-3.0", "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> "
                "<<beginOptional>>either<<endOptional>> version 3"),
    ("gpl-2.0", "gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> "
                "<<beginOptional>>either<<endOptional>> version 2"),
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0"),
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<var;work;1-12>> "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute <<beginOptional>>sublicense<<endOptional>> and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
            "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee "
            "is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice "
            "this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must "
            "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
            "materials provided with the distribution"),
    ("reserved-by", "copyright <<beginOptional>>c<<endOptional>> <<var;holder;1-20>> all rights reserved"),
]

_WORD = rb"[0-9a-z\x80-\xff]"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[0x80:] = True


def words_of(data: bytes) -> list[bytes]:
    return re.findall(_WORD + rb"+", data.lower())


def parse(template: str) -> list:
    """Items of a template: a word, ("optional", items) or ("any", least, most)."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            items = stack.pop()
            stack[-1].append(("optional", items))
        elif part.startswith("<<var;"):
            least, most = part[2:-2].split(";")[2].split("-")
            stack[-1].append(("any", int(least), int(most)))
        else:
            stack[-1] += words_of(part.encode())
    if len(stack) != 1:
        raise ValueError(f"an optional region is not closed: {template[:60]}")
    return stack[0]


@dataclass
class Automaton:
    """States over words: `moves[s]` lists (word, or None for any word; next state), `skips[s]` states reached without a word."""

    label: str
    items: list
    moves: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def __post_init__(self):
        self.anchor = b" ".join(self._first_words())
        if not self.anchor:
            raise ValueError(f"a template starts with a mandatory word: {self.label}")
        self.final = self._add(self.items, 0)

    def _first_words(self) -> list[bytes]:
        out = []
        for item in self.items[:3]:
            if not isinstance(item, bytes):
                break
            out.append(item)
        return out

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _add(self, items: list, at: int) -> int:
        for item in items:
            if isinstance(item, bytes):
                to = self._state()
                self.moves[at].append((item, to))
            elif item[0] == "optional":
                to = self._state()
                self.skips[self._add(item[1], at)].append(to)
                self.skips[at].append(to)
            else:
                _, least, most = item
                to = self._state()
                for k in range(most + 1):
                    if k >= least:
                        self.skips[at].append(to)
                    if k < most:
                        then = self._state()
                        self.moves[at].append((None, then))
                        at = then
            at = to
        return at

    def _reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def end(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from `start`, or None."""
        states, found, at = self._reach({0}), None, start
        while states:
            if self.final in states:
                found = at
            if at == len(words):
                break
            states = self._reach({to for s in states for word, to in self.moves[s] if word is None or word == words[at]})
            at += 1
        return found


def _finder(runs: list[bytes]) -> re.Pattern[bytes]:
    """Places where one of the word runs stands, also where they overlap."""
    gap = rb"[^0-9a-z\x80-\xff]+"
    return re.compile(rb"(?<!" + _WORD + rb")(?=(" + rb"|".join(gap.join(map(re.escape, r.split(b" "))) for r in runs) + rb")(?!" + _WORD + rb"))")


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(label, _finder([phrase.encode()]), phrase.split(" ")[0].encode()) for phrase, label in phrases.items()]
        self.automata: dict[bytes, list[Automaton]] = {}
        for label, template in templates:
            automaton = Automaton(label, parse(template))
            self.automata.setdefault(automaton.anchor, []).append(automaton)
        self.anchors = [(_finder([anchor]), anchor.split(b" ")[0], own) for anchor, own in self.automata.items()]

    def __call__(self, data: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans of the templates by words."""
        data = data.lower()
        word = _IS_WORD[np.frombuffer(data, np.uint8)]
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])) if len(data) else np.zeros(0, int)
        base, places = set(), []
        for label, finder, first in self.phrases:
            if first in data and (found := [m.start() for m in finder.finditer(data)]):
                base.add(label)
                places += found
        places = np.searchsorted(starts, places)
        labels, spans, words = set(base), [], None
        for finder, first, automata in self.anchors:
            if first not in data:
                continue
            for m in finder.finditer(data):
                words = words if words is not None else words_of(data)
                at = int(np.searchsorted(starts, m.start()))
                for automaton in automata:
                    if (end := automaton.end(words, at)) is not None:
                        labels.add(automaton.label)
                        spans.append((automaton.label, at, end))
        score = 1.0 if spans else 0.5 if base else 0.0
        return (len(starts), len(places), int(places.min()) if len(places) else None, int(places.max()) if len(places) else None,
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                ",".join(f"{name}:{a}:{b}" for name, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2]))))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("templates", pa.string())])


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: counts and places of phrases, labels, score and the spans of accepted templates.

    Whole texts are lower-cased in A-Z; words are runs of digits, a-z and anything beyond ASCII. A
    template is accepted where its automaton takes a run of words: mandatory words match exactly and in
    order, optional regions may be absent, replaceable ones take any words within their bounds. Spans
    are label:first word:end, the longest from each start. score: 1 with a template, a half with a
    phrase alone. Null and empty texts have no words. Rows that repeat get equal results; columns
    besides doc_id and text are ignored.
    """
    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            columns = list(zip(*(scanner(t) for t in utf8(batch.column(1))))) or [()] * 8
            yield pa.record_batch([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:])]], schema=_SCHEMA)

    return per_batch(documents(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                           "base_labels string, labels string, score double, templates string")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return scan(read(spark, folder, "documents")).drop("templates")


def _as_regex(items: list) -> str:
    """The items over words that are each followed by a blank."""
    out = ""
    for item in items:
        if isinstance(item, bytes):
            out += item.decode() + " "
        elif item[0] == "optional":
            out += f"(?:{_as_regex(item[1])})?"
        else:
            out += f"(?:[^ ]+ ){{{item[1]},{item[2]}}}"
    return out


def _oracle() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " || ".join(
        "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] IS NOT DISTINCT FROM '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    found = ", ".join(f"CASE WHEN regexp_matches(line, ' {_as_regex(parse(t))}') THEN '{label}' END" for label, t in TEMPLATES)
    join = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{word}') AS w FROM documents),
found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {places} AS p FROM words),
named AS (SELECT *, [{base}] AS b, [{found}] AS t FROM found)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word,
  CAST(list_max(p) - 1 AS BIGINT) AS last_word, {join.format("b")} AS base_labels, {join.format("b || t")} AS labels,
  CASE WHEN len(list_filter(t, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM named
"""


ORACLE = _oracle()
