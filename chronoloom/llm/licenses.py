"""Licence scans by template-markup matching.

A template is licence wording with marked regions: text between
``<<beginOptional>>`` and ``<<endOptional>>`` may be absent, and
``<<var;match=REGEX;max=N;min=M>>`` stands for M to N words (M is 0 if left out)
that each match REGEX.
All other words are mandatory. A template compiles to a token automaton; a text
is accepted where some run of its words takes the automaton to its end, so every
mandatory word must be there, in order and spelled alike. An automaton reads a
text only if the text has the template's longest mandatory phrase.

Besides, places of short base phrases are counted. Null text counts as empty: no
words, no labels, null places, score 0. Words are compared in lower case, and
overlapping places all count. Score is 1 where a template accepts, one half
where only base phrases stand, else 0. Very long texts are read whole, repeated
rows get equal results; of runs of one template that overlap the leftmost is
kept, and of those that begin alike the longest. Other columns are carried along
whatever their names, but for one with the name of ``out``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.license_texts import TEXTS

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices and first sentences with marked regions.
NOTICES = {
    "apache-notice": "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> <<var;match=[0-9]+;max=2>>",
    "cc-by-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY <<var;match=nc|nd|sa;max=2>> <<var;match=[0-9]+;max=2>>",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version <<var;match=[0-9]+;max=2>>",
    "mit-notice": "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<var;match=.+;max=3>>), to deal in the <<var;match=.+;max=3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the <<var;match=.+;max=3>>",
    "isc-text": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

#: Every template: notices, whole texts and headers of files.
TEMPLATES = NOTICES | TEXTS

RESULT = "struct<n_words:bigint,places:array<struct<label:string,word:bigint>>,accepted:array<struct<label:string,word:bigint,end_word:bigint>>>"
PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
RUN = pa.struct([("label", pa.string()), ("word", pa.int64()), ("end_word", pa.int64())])
ARROW = pa.struct([("n_words", pa.int64()), ("places", pa.list_(PLACE)), ("accepted", pa.list_(RUN))])

_plain = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_mark = re.compile(r"<<(.*?)>>")


def words(text: str | None) -> list[str]:
    return (text or "").encode().translate(_plain).decode().split(" ") if text else []


def parsed(template: str) -> list[tuple]:
    """Regions in order: ("must", words), ("may", words) or ("var", pattern, most words, least words)."""
    regions, optional = [], False
    for k, part in enumerate(_mark.split(template)):
        if k % 2 == 0:
            own = [w for w in words(part) if w]
            if own:
                regions.append(("may" if optional else "must", own))
        elif part.startswith("var"):
            given = dict(x.split("=", 1) for x in part.split(";")[1:])
            regions.append(("var", given.get("match", ".+"), int(given.get("max", 1)), int(given.get("min", 0))))
        else:
            optional = part == "beginOptional"
    return regions


class Automaton:
    """Token automaton of a template. ``moves[s]`` lists (word or pattern, next state); ``skips[s]`` lists states reached without a word."""

    def __init__(self, template: str):
        self.moves: list[list[tuple]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.anchor = ""
        at = 0
        for kind, *given in parsed(template):
            begin = at
            if kind == "var":
                test = re.compile(given[0])
                for _ in range(given[1]):
                    at = self._step(at, test)
                for s in range(begin + given[2], at):
                    self.skips[s].append(at)
            else:
                for word in given[0]:
                    at = self._step(at, word)
                if kind == "may":
                    self.skips[begin].append(at)
                elif len(given[0]) > self.anchor.count(" ") + bool(self.anchor):
                    self.anchor = " ".join(given[0])
        self.end = at
        self.reach = [self._closure(s) for s in range(at + 1)]

    def _step(self, at: int, test) -> int:
        self.moves[at].append((test, len(self.moves)))
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _closure(self, s: int) -> list[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return sorted(seen)

    def runs(self, own: list[str]) -> list[tuple[int, int]]:
        """Leftmost, longest, non-overlapping accepted runs [first, past last)."""
        longest: dict[int, int] = {}
        live: dict[int, int] = {}  # state -> where its run began, the earliest
        for i, word in enumerate(own):
            moved: dict[int, int] = {}
            for s in self.reach[0]:
                live.setdefault(s, i)
            for s, began in live.items():
                for test, to in self.moves[s]:
                    if test == word if isinstance(test, str) else test.fullmatch(word):
                        for t in self.reach[to]:
                            if began < moved.get(t, len(own)):
                                moved[t] = began
            if self.end in moved:
                longest[moved[self.end]] = i + 1
            live = moved
        out, past = [], 0
        for began, end in sorted(longest.items()):
            if began >= past:
                out.append((began, end))
                past = end
        return out


def scanner(templates: dict[str, str], base: dict[str, str]):
    """A column function: text to RESULT."""

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        phrases = re.compile("(?= (%s) )" % "|".join(map(re.escape, sorted(base, key=len, reverse=True))))
        automata = {label: Automaton(t) for label, t in templates.items()}
        for texts in batches:
            out = []
            for text in texts:
                own = [w for w in words(text.as_py()) if w]
                joined = f" {' '.join(own)} "
                places, word, seen = [], 0, 0
                for m in phrases.finditer(joined):
                    word += joined.count(" ", seen, m.start())
                    seen = m.start()
                    places.append({"label": base[m[1]], "word": word})
                accepted = [{"label": label, "word": a, "end_word": b} for label, machine in automata.items() if f" {machine.anchor} " in joined for a, b in machine.runs(own)]
                out.append({"n_words": len(own), "places": places, "accepted": accepted})
            yield pa.array(out, ARROW)

    return scan


def scan(docs: DataFrame, text: str = "text", out: str = "licences", templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with a RESULT struct in ``out``: base places and accepted template runs, in words from 0."""
    return docs.withColumn(out, scanner(TEMPLATES if templates is None else templates, BASE if base is None else base)(F.col(text)))


def _named(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs.select(key, text), text).select(key, F.col("licences").alias("l"))
    return found.select(
        key,
        F.col("l.n_words").alias("n_words"),
        F.size("l.places").cast("long").alias("n_base"),
        F.array_min("l.places.word").alias("first_word"),
        F.array_max("l.places.word").alias("last_word"),
        _named(F.col("l.places.label")).alias("base_labels"),
        _named(F.concat("l.places.label", "l.accepted.label")).alias("labels"),
        F.when(F.size("l.accepted") > 0, 1.0).when(F.size("l.places") > 0, 0.5).otherwise(0.0).alias("score"),
    )
