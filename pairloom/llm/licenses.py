"""License scan by a positional index of rare words.

The index holds, for every word of the license templates, its postings (template, position). A word's weight is
its inverse document frequency over the whole corpus, counted first. Of each template the highest weighted word of
the mandatory key phrase is the anchor; of one without key phrase, as many words as must agree at least once in
what is found. In a file only the words that are some template's anchor are looked up, so the frequent words of
a template cost nothing. Each occurrence at file position p with posting (t, q) proposes template t starting at
p - q, then the words of the template are compared at their places: the key phrase must stand there word for
word, and at least ``COVER`` of all words must agree. Every start that passes holds the anchor, so weights decide
the cost alone, not what is found.

Base phrases (``BASE_PHRASES``) are found at every place where their words stand consecutively. The index is small and of fixed size; files stream through their tasks, whole, without a shuffle.

Defined cases: null and empty texts have no words and no spans; an empty table gives no rows; repeated rows give
repeated rows; a template found at several starts gives a span for each. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import words as W
from pairloom.llm.tables import id_and_text, read

COVER = 0.8

# Phrases and labels of the base scan.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Sentences of public licenses, each with its label and the phrase that must stand word for word.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc", "this work is licensed under a creative commons attribution", "licensed under a creative commons"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
)


def _hashes(text: str) -> np.ndarray:
    return next(W.iter_words(pa.array([text]), W.ALNUM)).hashes


def vocabulary(templates=TEMPLATES) -> np.ndarray:
    """Sorted hashes of all template words."""
    return np.unique(np.concatenate([_hashes(t) for _, t, _ in templates] or [np.zeros(0, np.uint64)]))


def _find(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def document_frequency(docs: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each key stands, and the number of documents. As many rows reach the driver as keys."""

    def run(batches):
        for batch in batches:
            counts, rows = np.zeros(len(keys) + 1, np.int64), batch.num_rows
            for group in W.iter_words(batch.column(1), W.ALNUM):
                at = _find(keys, group.hashes)
                known = at >= 0
                row = np.repeat(np.arange(group.rows), np.diff(group.bounds))[known]
                pairs = np.unique(row * len(keys) + at[known])
                counts[:-1] += np.bincount(pairs % len(keys), minlength=len(keys))
            counts[-1] = rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys) + 1, dtype=np.int32)), pa.array(counts)], names=["key", "docs"])

    found = np.zeros(len(keys) + 1, np.int64)
    if len(keys):
        for row in docs.mapInArrow(run, "key int, docs long").groupBy("key").agg(F.sum("docs").alias("docs")).collect():
            found[row.key] = row.docs
    return found[:-1], int(found[-1])


class _Index:
    """Anchors' postings and the templates' own words."""

    def __init__(self, templates, base, frequency: dict[int, int], documents: int):
        self.labels = [label for label, _, _ in templates]
        self.words = [_hashes(text) for _, text, _ in templates]
        self.base = [(label, _hashes(phrase)) for phrase, label in base]
        self.key_at, postings = [], []
        for t, (own, (_, _, phrase)) in enumerate(zip(self.words, templates)):
            wanted = _hashes(phrase)
            starts = [q for q in range(len(own) - len(wanted) + 1) if (own[q : q + len(wanted)] == wanted).all()]
            if not starts:
                raise ValueError(f"key phrase not in its template: {phrase}")
            self.key_at.append((starts[0], len(wanted)))
            weight = {int(h): math.log((documents + 1) / (frequency.get(int(h), 0) + 1)) for h in own}
            places = range(starts[0], starts[0] + len(wanted)) if len(wanted) else range(len(own))
            missed = 0 if len(wanted) else sum(m / len(own) >= COVER for m in range(len(own)))
            ranked = sorted(places, key=lambda q: (-weight[int(own[q])], int(own[q]), q))
            postings += [(int(own[q]), t, q) for q in ranked[: missed + 1]]
        postings.sort()
        self.keys = np.array(sorted({h for h, _, _ in postings}), np.uint64)
        self.first = np.searchsorted(np.array([h for h, _, _ in postings], np.uint64), np.append(self.keys, self.keys[-1:]))
        self.first[-1:] = len(postings)
        self.template = np.array([t for _, t, _ in postings])
        self.place = np.array([q for _, _, q in postings])

    def spans(self, own: np.ndarray) -> list[tuple]:
        """(label, start, length, coverage, base) of one file's word hashes."""
        found = []
        for label, phrase in self.base:
            n = len(own) - len(phrase) + 1
            if n > 0:
                at = np.flatnonzero(own[:n] == phrase[0])
                for i in range(1, len(phrase)):
                    at = at[own[at + i] == phrase[i]]
                found += [(label, int(s), len(phrase), 1.0, True) for s in at]
        known = _find(self.keys, own)
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return found
        low, high = self.first[known[at]], self.first[known[at] + 1]
        counts = high - low
        post = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        template, start = self.template[post], np.repeat(at, counts) - self.place[post]
        for t in np.unique(template):
            wanted, (q, length) = self.words[t], self.key_at[t]
            starts = np.unique(start[template == t])
            starts = starts[(starts >= 0) & (starts + len(wanted) <= len(own))]
            for i in range(q, q + length):
                starts = starts[own[starts + i] == wanted[i]]
            for s in starts:
                same = own[s : s + len(wanted)] == wanted
                if same.mean() >= COVER:
                    found.append((self.labels[t], int(s), len(wanted), float(same.mean()), False))
        return found


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("coverage", pa.float64()), ("base", pa.bool_())])


def scan_licenses(
    documents: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, spans): every document with all license spans found; starts count words from 0."""
    docs = id_and_text(documents, id_col, text_col)
    keys = vocabulary(templates)
    counts, total = document_frequency(docs, keys)
    index = _Index(templates, base, dict(zip(keys.tolist(), counts.tolist())), total)

    def run(batches):
        for batch in batches:
            n_words, spans = [], []
            for group in W.iter_words(batch.column(1), W.ALNUM):
                for a, b in zip(group.bounds[:-1], group.bounds[1:]):
                    n_words.append(int(b - a))
                    spans.append([dict(zip(("label", "start", "length", "coverage", "base"), s)) for s in index.spans(group.hashes[a:b])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "n_words", "spans"]
            )

    return docs.mapInArrow(
        run, "doc_id long, n_words long, spans array<struct<label string, start long, length long, coverage double, base boolean>>"
    )


def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s.base)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s.start)).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s.start)).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)).alias("score"),
        F.filter("spans", lambda s: ~s.base).alias("template_spans"),
    )


QUERIES = {"op4_license_scan": (op4, None)}
