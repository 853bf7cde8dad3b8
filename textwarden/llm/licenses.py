"""License scan with a positional index of rare words.

Licence wordings (``TEMPLATES``, or any number by parameter) are indexed by
word and place. How many documents hold each word of the index is counted over
all documents; of every mandatory phrase the word with the highest inverse
document frequency becomes its posting: (template, phrase, place). The words of
a document that have postings are looked up; a template of which all of them
are there has its phrases verified around them, and the starts that these give
are intersected by relative position, give or take ``SLACK`` words. A start on
which at least two words of the template agree gives the template's label; its
score is the share of the template's words that stand in their order. That
gives what votes of all words of the index would give (tested), and templates
that share no rarest word with a document cost it nothing (tested).

The base labels come from exact phrases and always stay.

Defined results: words are runs of digits, letters and characters beyond
ASCII, A-Z lower-cased; text null or "" has no words; repeated rows count and
score as often as they come; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 3
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases that give a base label wherever their words stand one after the other.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, wording, mandatory phrases. Openings and notices of well-known licences.
TEMPLATES = (
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("lgpl-3", "this library is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3", "this program is licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text; bytes.lower() changes A-Z only."""
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]  # place inside the template, words


@dataclass
class Index:
    """Postings word -> (template, place), and the phrases of the base labels by first word."""

    templates: list[Template] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    first: dict[bytes, list[tuple[list[bytes], str]]] = field(default_factory=dict)


def build_index(templates=TEMPLATES, phrases=PHRASES) -> Index:
    index = Index()
    for label, wording, keys in templates:
        words = words_of(wording)
        placed = []
        for key in map(words_of, keys):
            placed.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
        for i, w in enumerate(words):
            index.postings.setdefault(w, []).append((len(index.templates), i))
        index.templates.append(Template(label, words, placed))
    for phrase, label in phrases.items():
        index.first.setdefault(words_of(phrase)[0], []).append((words_of(phrase), label))
    return index


def base_places(words: list[bytes], index: Index) -> list[tuple[int, str]]:
    """Start and label of every place of every phrase."""
    out = []
    for first, rest in index.first.items():
        at = -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            out += [(at, label) for phrase, label in rest if words[at : at + len(phrase)] == phrase]
    return out


def _in_order(words: list[bytes], start: int, template: Template) -> float:
    """Share of the template's words that stand in their order near ``start``."""
    at, met = max(0, start - SLACK), 0
    for i, w in enumerate(template.words):
        for j in range(at, min(len(words), start + i + SLACK + 1)):
            if words[j] == w:
                at, met = j + 1, met + 1
                break
    return met / len(template.words)


@dataclass
class Anchors:
    """The positional index that texts are looked up in: for the rarest word of each mandatory phrase its
    (template, phrase, place in the phrase); and for templates without phrases each word's (template, place)."""

    postings: dict[bytes, list[tuple[int, int, int]]] = field(default_factory=dict)
    free: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)


def anchored(index: Index, idf: dict[bytes, float]) -> Anchors:
    out = Anchors()
    for t, template in enumerate(index.templates):
        for p, (_, key) in enumerate(template.phrases):
            rare = min(set(key), key=lambda w: (-idf.get(w, math.inf), w))
            out.postings.setdefault(rare, []).append((t, p, key.index(rare)))
        if not template.phrases:
            for q, w in enumerate(template.words):
                out.free.setdefault(w, []).append((t, q))
    return out


def _places(words: list[bytes], wanted: set[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {w: [] for w in wanted}
    if wanted:
        for place, w in enumerate(words):
            if w in wanted:
                out[w].append(place)
    return out


def _starts(words: list[bytes], index: Index, anchors: Anchors) -> dict[int, set[int]]:
    """Per template the starts on which every mandatory phrase stands at its place, give or take ``SLACK`` words.

    Only templates are looked at of which all rarest words stand in the text;
    the places that their postings give are intersected phrase by phrase.
    """
    distinct = set(words)
    held: dict[int, list[tuple[bytes, int, int]]] = {}
    for w in anchors.postings.keys() & distinct:
        for t, p, inside in anchors.postings[w]:
            held.setdefault(t, []).append((w, p, inside))
    held = {t: found for t, found in held.items() if len(found) == len(index.templates[t].phrases)}
    free = anchors.free.keys() & distinct
    places = _places(words, {w for found in held.values() for w, _, _ in found} | free)
    out: dict[int, set[int]] = {}
    for t, found in held.items():
        starts: set[int] | None = None
        for w, p, inside in found:
            at, key = index.templates[t].phrases[p]
            sure = [k - inside for k in places[w] if k >= inside and words[k - inside : k - inside + len(key)] == key]
            near = {k - at + d for k in sure for d in range(-SLACK, SLACK + 1)}
            starts = near if starts is None else starts & near
            if not starts:
                break
        if starts:
            out[t] = starts
    for w in free:
        for t, q in anchors.free[w]:
            out.setdefault(t, set()).update(k - q for k in places[w])
    return out


def scan(words: list[bytes], index: Index, idf: dict[bytes, float], anchors: Anchors | None = None) -> dict[str, float]:
    """Labels of the templates found, with their scores; the cost does not grow with templates that share no rarest word."""
    out: dict[str, float] = {}
    for t, starts in _starts(words, index, anchors or anchored(index, idf)).items():
        template = index.templates[t]
        for start in starts:
            agreed = {w for k, w in enumerate(template.words, start) if 0 <= k < len(words) and words[k] == w}
            if len(agreed) >= 2:
                out[template.label] = max(out.get(template.label, 0.0), _in_order(words, start, template))
    return out


def document_frequencies(docs: DataFrame, index: Index) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and in how many of them each word of the index stands; bounded by the index."""
    vocabulary = frozenset(index.postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
            seen[b""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    got = {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(b"", 0), got


def scan_licenses(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    index = index or build_index()
    rows, df = document_frequencies(docs, index)
    idf = {w: math.log((1 + rows) / (1 + df.get(w, 0))) for w in index.postings}
    anchors = anchored(index, idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                base = base_places(words, index)
                found = scan(words, index, idf, anchors)
                starts = [at for at, _ in base]
                base_labels = {label for _, label in base}
                out.append(
                    (
                        doc,
                        len(words),
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(base_labels | found.keys())),
                        1.0 if base else max(found.values(), default=0.0),
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
