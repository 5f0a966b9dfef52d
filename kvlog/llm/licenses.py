"""License scans with a positional rare-token index.

``TEMPLATES`` are short licence passages; their words are posted as word -> (template, place).  Of each template the rarest
word of its key phrases (highest IDF, counted over all documents) is looked up, and every place where it stands gives a
start of the template relative to the document.  There the key phrases must all stand at their exact places, and the
template's words are compared place by place; then its label is added and its share of equal words counts as score.  As a
match holds all words of its key phrases, no match is missed, however many licences a text has; the IDF only changes speed.
Base phrases are found wherever their words stand consecutively; a document with a base phrase scores 0.5 at least.

The templates are the notices' own sentences; the full licence texts that follow them in files hold these sentences or none
of ours, so longer templates would add no labels.

Defined cases: null and empty texts have no words, labels '' and score 0; repeated rows are scanned one by one; very long
texts are scanned whole; words are compared by 64-bit hashes; ids are returned with their own type, null ids as null; an empty
table stays empty; other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlog.llm.bytegrams import Texts, groups, lean
from kvlog.llm.common import ship, table

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> (passage, key phrases that must stand at their places).
TEMPLATES = {
    "all-rights-reserved": ("all rights reserved", ["all rights reserved"]),
    "apache-2.0-notice": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "apache-2.0-terms": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    "bsd-terms": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "cc-by": ("this work is licensed under a creative commons attribution", ["creative commons attribution"]),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "mit-notice": ("released under the mit license", ["the mit license"]),
    "mpl-2.0-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "spdx": ("spdx license identifier", ["spdx license identifier"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
}
MIN_SHARE = 0.6

GAP = np.zeros(256, dtype=bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Index:
    """Words of the templates and base phrases by number, and their postings."""

    def __init__(self):
        texts = [*(t for t, _ in TEMPLATES.values()), *BASE]
        self.words = sorted({w for t in texts for w in t.split()})
        number = {w: i for i, w in enumerate(self.words)}
        t = Texts([w.encode() for w in self.words])
        t.split(GAP)
        hashes = t.word_hashes()
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.templates, self.keys = [], []
        for text, phrases in TEMPLATES.values():
            w = text.split()
            self.templates.append(np.array([number[x] for x in w]))
            key: set[int] = set()
            for p in map(str.split, phrases):
                at = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
                key.update(range(at, at + len(p)))
            self.keys.append(np.array(sorted(key)))
        self.labels = list(TEMPLATES)
        self.base = [([number[w] for w in p.split()], label) for p, label in BASE.items()]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _numbered(texts: pa.Array, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of all words, first word of each text) of groups of texts."""
    for _, part in groups(texts):
        t = Texts(part, lower=True)
        t.split(GAP)
        yield index.number(t.word_hashes()), t.first


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[int, dict[int, int]]:
    """Number of documents, and of those with each licence word, over whole texts."""
    index = Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(len(index.words), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for numbers, first in _numbered(batch.column(0), index):
                at = np.flatnonzero(numbers >= 0)
                doc = np.searchsorted(first, at, side="right")
                pairs = np.unique(doc * len(index.words) + numbers[at])
                counts += np.bincount(pairs % len(index.words), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(counts))], pa.int64()), pa.array([n, *counts.tolist()], pa.int64())], names=["word", "df"])

    ship(docs.sparkSession)
    found = docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    by = {r["word"]: r["df"] for r in found}
    return by.pop(-1, 0), by


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates (label:start:share, comma-joined)."""
    index = Index()
    n_docs, df = document_frequency(docs, text)
    idf = np.array([np.log((1 + n_docs) / (1 + df.get(i, 0))) for i in range(len(index.words))])

    #: of each template, the place of its rarest word among the key phrases
    rarest = [int(at[np.argmax(idf[t[at]])]) for t, at in zip(index.templates, index.keys, strict=True)]

    def templates(numbers: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[str, int, float]]]:
        """Verified templates of each text that has some."""
        out: dict[int, list[tuple[str, int, float]]] = {}
        known = np.flatnonzero(numbers >= 0)
        for label, words, key, place in zip(index.labels, index.templates, index.keys, rarest, strict=True):
            at = known[numbers[known] == words[place]]
            doc = np.searchsorted(first, at, side="right") - 1
            start = at - place
            ok = (start + key[0] >= first[doc]) & (start + key[-1] < first[doc + 1])
            start, doc = start[ok], doc[ok]
            for k in key:
                ok = numbers[start + k] == words[k]
                start, doc = start[ok], doc[ok]
            for s, d in zip(start.tolist(), doc.tolist(), strict=True):
                places = s + np.arange(len(words))
                inside = (places >= first[d]) & (places < first[d + 1])
                share = float((numbers[places[inside]] == words[inside]).sum() / len(words))
                if share >= MIN_SHARE:
                    out.setdefault(d, []).append((label, s - int(first[d]), share))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for numbers, first in _numbered(batch.column(1), index):
                hits: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in index.base:
                    m = max(len(numbers) - len(phrase) + 1, 0)
                    ok = np.ones(m, dtype=bool)
                    for j, w in enumerate(phrase):
                        ok &= numbers[j : j + m] == w
                    at = np.flatnonzero(ok)
                    doc = np.searchsorted(first, at, side="right") - 1
                    for p, d in zip(at.tolist(), doc.tolist(), strict=True):
                        if p + len(phrase) <= first[d + 1]:
                            hits.setdefault(d, []).append((p - int(first[d]), label))
                found = templates(numbers, first)
                for d in range(len(first) - 1):
                    a, b = int(first[d]), int(first[d + 1])
                    base = hits.get(d, [])
                    more = sorted(found.get(d, []))
                    names = sorted({x[1] for x in base})
                    rows.append(
                        (
                            b - a,
                            len(base),
                            min((x[0] for x in base), default=None),
                            max((x[0] for x in base), default=None),
                            ",".join(names),
                            ",".join(sorted({*names, *(x[0] for x in more)})),
                            max([0.5 * bool(base), *(x[2] for x in more)]),
                            ",".join(f"{t}:{s}:{share:.3f}" for t, s, share in more),
                        )
                    )
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, templates string")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
