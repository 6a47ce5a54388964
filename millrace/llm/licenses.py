"""License scans by template markup.

A template is the wording of a notice. ``[[ … ]]`` marks words that may be missing, ``{{n}}`` a place for
up to n words of any kind (a name, a year). All templates compile into one automaton over words, whose
subsets are built as texts need them. A place in a text matches if its words spell out the
mandatory wording exactly, with or without the optional parts and with anything in the open places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of a text with A-Z lower-cased
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PART = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|" + WORD.pattern)


@dataclass(frozen=True)
class Template:
    label: str
    text: str


# Phrases of the query's contract.
PHRASES = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
# Wording of public license notices.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license [[version]] 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license [[version]] 3 [[or any later version]]"),
    Template("gpl-2.0", "licensed under the gnu general public license [[version]] 2 [[or any later version]]"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"),
    Template("mit", "[[released]] [[licensed]] under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"),
    Template("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc-4.0", "licensed under [[a]] cc by nc 4 0 [[international]] [[license]]"),
    Template("cc-by-4.0", "licensed under [[a]] [[creative commons attribution]] cc by 4 0 [[international]] [[license]]"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 [[international]] license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("all-rights-reserved", "copyright [[c]] {{2}} by {{6}} all rights reserved"),
)


@dataclass
class _Node:
    """One state: words lead to the next state, as does any word if ``any_word``; ``empty`` are moves without a word."""

    word: str | None = None
    any_word: bool = False
    to: int = -1
    empty: tuple[int, ...] = ()
    accepts: int = -1


class TemplateAutomaton:
    """The union of the templates as one automaton over words, determinised lazily."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.nodes: list[_Node] = []
        self.starts: dict[str, frozenset[int]] = {}
        first: dict[str, set[int]] = {}
        for number, template in enumerate(templates):
            for state in self._closure({self._compile(number, PART.findall(template.text.lower()))}):
                node = self.nodes[state]
                if node.any_word or node.accepts >= 0:
                    raise ValueError(f"template {template.label} must begin with a word")
                if node.word is not None:
                    first.setdefault(node.word, set()).add(state)
        self.starts = {word: frozenset(states) for word, states in first.items()}
        self._moves: dict[tuple[frozenset[int], str], tuple[frozenset[int], tuple[int, ...]]] = {}

    def _add(self, **values) -> int:
        self.nodes.append(_Node(**values))
        return len(self.nodes) - 1

    def _compile(self, number: int, parts: list[str]) -> int:
        """Build from the end; returns the first state."""
        after = self._add(accepts=number)
        ends: list[int] = []
        for part in reversed(parts):
            if part == "]]":
                ends.append(after)
            elif part == "[[":
                after = self._add(empty=(after, ends.pop()))
            elif part.startswith("{{"):
                done = after
                for _ in range(int(part[2:-2])):
                    after = self._add(empty=(self._add(any_word=True, to=after), done))
            else:
                after = self._add(word=part, to=after)
        if ends:
            raise ValueError(f"unbalanced optional part in template {number}")
        return after

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.nodes[todo.pop()].empty:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def step(self, states: frozenset[int], word: str) -> tuple[frozenset[int], tuple[int, ...]]:
        """(states after the word, templates complete there)."""
        key = (states, word)
        if key not in self._moves:
            after = {self.nodes[s].to for s in states if self.nodes[s].any_word or self.nodes[s].word == word}
            closed = self._closure(after)
            live = frozenset(s for s in closed if self.nodes[s].word is not None or self.nodes[s].any_word)
            if len(self._moves) > 50_000:
                self._moves.clear()
            self._moves[key] = (live, tuple(sorted({self.nodes[s].accepts for s in closed if self.nodes[s].accepts >= 0})))
        return self._moves[key]

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, start, end) of each template's longest match from each start, in words."""
        found = []
        for start, word in enumerate(words):
            states = self.starts.get(word)
            longest: dict[int, int] = {}
            at = start
            while states and at < len(words):
                states, done = self.step(states, words[at])
                at += 1
                for number in done:
                    longest[number] = at
            found += [(number, start, end) for number, end in sorted(longest.items())]
        return found


def mandatory_words(template: Template) -> list[list[str]]:
    """Runs of words that every match contains side by side."""
    runs, depth = [[]], 0
    for part in PART.findall(template.text.lower()):
        if part in ("[[", "]]") or part.startswith("{{"):
            depth += (part == "[[") - (part == "]]")
            runs.append([])
        elif not depth:
            runs[-1].append(part)
    return [r for r in runs if r]


def may_match(text: Column, templates: tuple[Template, ...]) -> Column:
    """False only for texts in which no template can match: they lack each template's longest mandatory run."""
    lowered, tests = F.lower(text), {}
    for template in templates:
        runs = mandatory_words(template)
        if not runs:
            return F.lit(True)
        word = max((w for run in runs for w in run), key=len)
        if len(word) >= 5:
            tests[word] = F.contains(lowered, F.lit(word))
        else:
            pattern = GAP.join(re.escape(w) for w in max(runs, key=len))
            tests[pattern] = lowered.rlike(pattern)
    out = F.lit(False)
    for test in tests.values():
        out = out | test
    return F.coalesce(out, F.lit(False))


def scan_licenses(docs: DataFrame, keep: list[str], phrases: tuple[Template, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    ``phrases`` are templates that count as base. n_base counts their places, first_word and last_word are the
    smallest and largest start (null without one). ``labels`` has the labels of both kinds, distinct,
    sorted and comma-joined; ``matches`` lists (label, start, end) in words. ``score`` is 0 without a match
    and nears 1 with the words of the longest one. Null texts count as empty. Columns not kept are ignored.
    """
    both = (*phrases, *templates)
    schema = docs.select(*keep).schema.simpleString()[7:-1]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("bigint").alias("n_words"), F.when(may_match(text, both), text).alias("_text"))
    n_base = len(phrases)
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automaton = TemplateAutomaton(both)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(len(keep) + 1).to_pylist():
                found = automaton.matches(WORD.findall(text.encode().lower().decode())) if text else []
                base = [m for m in found if m[0] < n_base]
                longest = max((end - start for _, start, end in found), default=0)
                out.append((
                    len(base), min((m[1] for m in base), default=None), max((m[1] for m in base), default=None),
                    ",".join(sorted({both[m[0]].label for m in base})), ",".join(sorted({both[m[0]].label for m in found})),
                    1 - 0.5**longest, [{"label": both[k].label, "start": a, "end": b} for k, a, b in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans)
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *columns], [*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    kinds = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"{schema}, {kinds}")
