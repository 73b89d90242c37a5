"""License scans with a generalised suffix automaton of template words.

The automaton holds every template as a word sequence.  A task streams each
document's words through it: the state and length after a word are the longest
run ending there that occurs in some template (matching statistics), in one
step per word.  Where a run of ``MIN_RUN`` words or more can't be extended it is
a match; matches of one template that follow one another in document and
template with at most ``MAX_GAP`` words between them are chained into a span,
and the template's share that a span covers is its score.

Base phrases, and templates that stand whole, are found exactly: they end
wherever the run's state or one that its suffix links lead to is their own.  Any
other run counts for the templates that hold all of it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import small_batches, text_rows

#: Phrases whose places are counted, and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wordings of licence notices (fixed values).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
MIN_RUN, MAX_GAP, MIN_COVER = 3, 3, 0.8
#: After A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, in UTF-8 bytes.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Automaton:
    """Suffix automaton of several word sequences, with each state's places."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Places ``(sequence, end)`` of a state's strings, its own and those below it.
        self.ends: list[set[tuple[int, int]]] = [set()]
        for n, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((n, i))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """The state of ``parent``'s longest string plus ``word`` as a state of its own."""
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._state(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = twin
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.step[at][word])
        return new

    def find(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][word]
        return state


class Scanner:
    """Templates made ready; called with a text's bytes gives its figures."""

    def __init__(self, base=BASE, templates=TEMPLATES, min_run=MIN_RUN, max_gap=MAX_GAP, min_cover=MIN_COVER):
        self.base = [(words(p.encode()), label) for p, label in base]
        self.templates = [(words(p.encode()), label) for label, p in templates]
        sequences = [w for w, _ in self.base + self.templates]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        coded = [[self.ids[w] for w in s] for s in sequences]
        self.automaton = Automaton(coded)
        self.sizes = [len(s) for s in sequences]
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        #: For each state, the sequences that end where its strings do: (sequence, words).
        own: dict[int, list[tuple[int, int]]] = {}
        for n, s in enumerate(coded):
            if s:
                own.setdefault(self.automaton.find(s), []).append((n, len(s)))
        self.phrases: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.length)):
            found, at = [], state
            while at > 0:
                found += own.get(at, [])
                at = self.automaton.link[at]
            self.phrases.append(found)

    def __call__(self, text: bytes) -> dict:
        found = words(text)
        get = self.ids.get
        step, link, length, phrases = self.automaton.step, self.automaton.link, self.automaton.length, self.phrases
        state = size = n_base = 0
        first = last = None
        base_labels: set[str] = set()
        whole: dict[int, int] = {}  # first place of templates that stand whole
        runs: list[tuple[int, int, int]] = []  # end, words, state of runs that can't be extended
        for i, word in enumerate(map(get, found)):
            if word is None:
                if size:
                    if size >= self.min_run:
                        runs.append((i, size, state))
                    state = size = 0
                continue
            if word not in step[state]:
                if size >= self.min_run:
                    runs.append((i, size, state))
                while state and word not in step[state]:
                    state = link[state]
                    size = length[state]
            if word in step[state]:
                state = step[state][word]
                size += 1
                for n, k in phrases[state]:
                    if k <= size:
                        start = i - k + 1
                        if n >= len(self.base):
                            whole.setdefault(n, start)
                            continue
                        n_base += 1
                        base_labels.add(self.base[n][1])
                        first = start if first is None else min(first, start)
                        last = start if last is None else max(last, start)
        if size >= self.min_run:
            runs.append((len(found), size, state))
        spans = self._chain(runs, whole) if runs or whole else []
        score = max([1.0 if n_base else 0.0, *(s["cover"] for s in spans)])
        return {"n_words": len(found), "n_base": n_base, "first_word": first, "last_word": last,
                "base_labels": ",".join(sorted(base_labels)),
                "labels": ",".join(sorted(base_labels | {s["label"] for s in spans if s["cover"] >= self.min_cover})),
                "score": score, "spans": [s for s in spans if s["cover"] >= self.min_cover]}

    def _chain(self, runs: list[tuple[int, int, int]], whole: dict[int, int]) -> list[dict]:
        """Chains of runs per template: each run joins the chain that ends nearest before it."""
        open_: dict[int, list[dict]] = {}
        n_base = len(self.base)
        for end, size, state in runs:
            for template, at in self.automaton.ends[state]:
                if template < n_base or template in whole:
                    continue
                start, t_start = end - size, at + 1 - size
                best = None
                for chain in open_.setdefault(template, []):
                    if (0 <= start - chain["end"] <= self.max_gap and 0 <= t_start - chain["t_end"] <= self.max_gap
                            and (best is None or chain["words"] > best["words"])):
                        best = chain
                if best is None:
                    open_[template].append({"start": start, "end": end, "t_end": at + 1, "words": size})
                else:
                    best.update(end=end, t_end=at + 1, words=best["words"] + size)
                live = [c for c in open_[template] if end - c["end"] <= self.max_gap + 1]
                top = max(open_[template], key=lambda c: c["words"])
                open_[template] = live if any(c is top for c in live) else [*live, top]
        spans = [{"label": self.templates[n - n_base][1], "start_word": start, "end_word": start + self.sizes[n],
                  "cover": 1.0} for n, start in whole.items()]
        for template, chains in open_.items():
            top = max(chains, key=lambda c: (c["words"], -c["start"]))
            spans.append({"label": self.templates[template - n_base][1], "start_word": top["start"],
                          "end_word": top["end"], "cover": min(1.0, top["words"] / self.sizes[template])})
        return sorted(spans, key=lambda s: (s["start_word"], s["label"]))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
           ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES,
                  min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` per row.

    A null or empty text has no words, no labels and score 0.  Rows are
    independent: repeated rows and null ids give a row each.  ``spans`` are the
    widest chain of each template that covers ``min_cover`` of it, in words from
    0, end exclusive.  ``score`` is the largest share of a template covered, 1
    where a base phrase stands.  No shuffle: the automaton travels with the task.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(base, templates, min_run, max_gap, min_cover)

    def scan(batches):
        for part, texts in text_rows(batches):
            found = [scanner(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([f[k] for f in found], kind) for k, kind in _FIELDS)],
                names=["doc_id", *(k for k, _ in _FIELDS)])
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, "
                           "first_word bigint, last_word bigint, base_labels string, labels string, score double, "
                           "spans array<struct<label: string, start_word: bigint, end_word: bigint, cover: double>>")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.to_json("spans").alias("spans"))
