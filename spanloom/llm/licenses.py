"""Licence detection by a positional index of rare licence words.

The index holds, for each word of the templates' mandatory phrases, where it
stands in which template.  Licence words are weighed by inverse document
frequency over all documents.  A file's own licence words are looked up from
the rarest on; each posting's relative positions (place in the file less place
in the template) are intersected with what the template has left.  A template
is given up once nothing is left, never at a count of words.  Where all its
postings agree, its mandatory phrases and the share of its words in place are
verified.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import alnum_words, texts, tidy

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Template label, text, and the phrases that must stand in their places.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)


@dataclass
class Index:
    words: list[list[bytes]]
    labels: list[str]
    #: By template: (position, words) of each mandatory phrase.
    needed: list[list[tuple[int, list[bytes]]]]
    postings: dict[bytes, list[tuple[int, int]]]
    phrases: list[tuple[list[bytes], str]]


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n, found, at = len(phrase), [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                found.append(at)
    except ValueError:
        return found


def build_index(templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Index:
    words = [alnum_words(t.encode()) for _, t, _ in templates]
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for k, ws in enumerate(words):
        for p, w in enumerate(ws):
            postings[w].append((k, p))
    needed = [[(_places(ws, p)[0], p) for p in (alnum_words(x.encode()) for x in must)] for ws, (_, _, must) in zip(words, templates, strict=True)]
    return Index(words, [t for t, _, _ in templates], needed, dict(postings), [(alnum_words(p.encode()), label) for p, label in phrases.items()])


def _count(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    vocabulary = frozenset(index.postings)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                counts[b""] += 1
                counts.update(vocabulary.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def licence_idf(docs: DataFrame, index: Index) -> dict[bytes, float]:
    """Inverse document frequency of each licence word over all documents; tasks add up their own counts first."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(index), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"].encode(): r["n"] for r in rows}
    return {w: math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) for w in index.postings}


@dataclass
class Lookup:
    """The index in order of IDF."""

    index: Index
    #: By word of a mandatory phrase: its (template, position) postings; words by falling IDF.
    postings: dict[bytes, list[tuple[int, int]]]
    #: By template: the words that its mandatory phrases need.
    words: list[frozenset[bytes]]


def by_rarity(index: Index, idf: dict[bytes, float]) -> Lookup:
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for template, needed in enumerate(index.needed):
        for p, ws in needed:
            for k, w in enumerate(ws):
                if (template, p + k) not in postings[w]:
                    postings[w].append((template, p + k))
    order = sorted(postings, key=lambda w: (-idf[w], w))
    return Lookup(index, {w: postings[w] for w in order}, [frozenset(w for _, ws in needed for w in ws) for needed in index.needed])


def match(words: list[bytes], lookup: Lookup, cover: float = 0.6) -> list[tuple[str, int, float]]:
    """(template label, its first word's place, share of its words in place) of each place that is verified.

    There every mandatory phrase stands where the template has it and ``cover``
    of the template's words are in place; the template may be cut off by either
    end of the text.
    """
    mine = lookup.postings.keys() & words
    live = {k for k, needs in enumerate(lookup.words) if needs <= mine}
    if not live:
        return []
    wanted = frozenset().union(*(lookup.words[k] for k in live))
    places: dict[bytes, list[int]] = defaultdict(list)
    for at, w in enumerate(words):
        if w in wanted:
            places[w].append(at)
    left: dict[int, set[int]] = {}
    # the lookup's words are in order of rarity, so common ones meet few templates that are left
    for w in (w for w in lookup.postings if w in wanted):
        for template, p in lookup.postings[w]:
            if template not in live:
                continue
            if template not in left:
                left[template] = {at - p for at in places[w]}
            elif len(left[template]) < len(places[w]):
                left[template] = {b for b in left[template] if 0 <= b + p < len(words) and words[b + p] == w}
            else:
                left[template] &= {at - p for at in places[w]}
            if not left[template]:
                live.discard(template)
    index, found = lookup.index, []
    for template in sorted(live):
        body = index.words[template]
        for begin in sorted(left[template]):
            if not all(begin + p >= 0 and words[begin + p : begin + p + len(ws)] == ws for p, ws in index.needed[template]):
                continue
            share = sum(0 <= begin + p < len(words) and words[begin + p] == w for p, w in enumerate(body)) / len(body)
            if share >= cover:
                found.append((index.labels[template], begin, share))
    return found


def _scan(index: Index, idf: dict[bytes, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    firsts, lookup = {p[0] for p, _ in index.phrases}, by_rarity(index, idf)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                words = alnum_words(text)
                places, base = [], set()
                if not firsts.isdisjoint(words):
                    for phrase, label in index.phrases:
                        if got := _places(words, phrase):
                            places += got
                            base.add(label)
                found = match(words, lookup)
                labels = sorted(base | {f[0] for f in found})
                score = 1.0 if base else max((f[2] for f in found), default=0.0)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, [{"label": a, "word": b, "cover": c} for a, b, c in found]))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("cover", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    return run


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licence labels of every row of ``docs`` (``doc_id`` long, ``text``).

    ``n_words``; ``n_base``: all places of base phrases; ``first_word`` and
    ``last_word``: the smallest and largest word they start at, else null;
    ``base_labels``; ``labels``: these and the templates' that were verified,
    distinct and sorted; ``score``: 1 with a base phrase, else the largest
    share of a template's words found in place, else 0; ``found``: label, place
    and share of each template.  A null or empty text has no words; repeated
    rows are scanned each for itself; an empty table gives no rows; other
    columns are not read.  Two passes without a shuffle of the texts.
    """
    index = build_index()
    idf = licence_idf(docs, index)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label:string,word:long,cover:double>>"
    return mine.mapInArrow(_scan(index, idf), kinds)
