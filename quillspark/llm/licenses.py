"""License scan by a positional index of rare words.

Notices of licences are templates: words at relative positions, some of which (the
key phrase) are mandatory. A place in a text bears a notice if the key phrase stands
there and at least ``SHARE`` of the notice's words stand at their positions.

The index holds, of every notice, its words of highest inverse document frequency,
counted over all documents. A notice of m words that may miss e of them is indexed
by its e + 2 rarest positions, so every place that bears it holds at least two of
them (or all, in a shorter notice). A file's words are looked up in the index; postings
that agree on where the notice would begin meet, and only such places are verified
against the whole notice and its key phrase. Frequencies thus decide how much is
verified, never what is found.

Phrases of ``PHRASES`` are found on their own, wherever their words stand in a row.

Texts are read in two narrow passes, frequencies and scan; only counts of the
notices' own words are gathered. A task holds a few megabytes of text at a time,
or one longer text.

Defined cases: a null text is empty and has no words; of notices that tie, all
labels are given; repeated rows give repeated rows; other columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import LOWER, hashes, ragged, slices, texts, words
from .tables import text_of

SHARE = 0.8
SLICE_BYTES = 1 << 22
VERIFY_ROWS = 1 << 14

#: Bytes between words: all of ASCII but digits and letters (texts are lower-cased before).
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[48:58] = False
BETWEEN[97:123] = False

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Fixed values: (label, notice, key phrase in it), the public wording of each licence.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     "to deal in the software without restriction"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("mit", "released under the terms of the mit license", "the mit license"),
    ("mit", "spdx license identifier mit", "identifier mit"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "source and binary forms"),
    ("bsd", "licensed under the bsd license", "the bsd license"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
            "the following disclaimer in the documentation", "in binary form must reproduce"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("apache-2", "spdx license identifier apache 2 0", "identifier apache 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation "
              "either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation "
              "either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3",
     "lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3",
     "affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     "creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "this work has been marked as dedicated to the public domain", "dedicated to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[str, ...]
    mandatory: tuple[int, ...]

    @classmethod
    def of(cls, label: str, text: str, key: str) -> Notice:
        own, must = tuple(text.split()), key.split()
        at = next(i for i in range(len(own)) if list(own[i:i + len(must)]) == must)
        return cls(label, own, tuple(range(at, at + len(must))))

    def needed(self, share: float) -> int:
        """The words that must stand at their positions."""
        return int(np.ceil(share * len(self.words) - 1e-9))

    def indexed(self, share: float) -> int:
        return min(len(self.words), len(self.words) - self.needed(share) + 2)


def _hash(own: list[str]) -> np.ndarray:
    """The hashes that ``hashes`` gives to these words in a text."""
    data = np.frombuffer("".join(own).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in own])
    return hashes(data, np.concatenate([[0], ends[:-1]]), ends)


class Vocabulary:
    """Numbers of the words that notices and phrases are made of; -1 is any other word."""

    def __init__(self, own: list[str]):
        self.words = sorted(set(own))
        codes = _hash(self.words)
        order = np.argsort(codes)
        self.codes, self.numbers = codes[order], order
        self.lengths = np.array([len(w.encode()) for w in self.words])
        self.number = {w: i for i, w in enumerate(self.words)}

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes = hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        found = self.numbers[at]
        same = (self.codes[at] == codes) & (self.lengths[found] == ends - starts)
        return np.where(same, found, -1)


def vocabulary(notices: list[Notice], phrases: dict[str, str]) -> Vocabulary:
    return Vocabulary([w for n in notices for w in n.words] + [w for p in phrases for w in p.split()])


def _numbered(column: pa.Array, known: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers of some texts at a time, and where in them each text begins (and the last ends)."""
    data, offsets = texts(column)
    for a, b in slices(offsets, SLICE_BYTES):
        piece = LOWER[data[offsets[a]:offsets[b]]]
        starts, ends, begin = words(piece, offsets[a:b + 1] - offsets[a], BETWEEN)
        yield known.look_up(piece, starts, ends), begin


def _frequency_rows(known: Vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known.words), np.int64)
        for batch in batches:
            for own, begin in _numbered(batch.column(0), known):
                at = np.flatnonzero(own >= 0)
                doc = np.searchsorted(begin, at, side="right") - 1
                pairs = np.unique(doc * len(known.words) + own[at])
                counts += np.bincount(pairs % len(known.words), minlength=len(known.words))
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["word", "n"])
    return run


def frequencies(docs: DataFrame, known: Vocabulary) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; gathers one number per such word."""
    rows = (docs.select(text_of(docs).alias("text")).mapInArrow(_frequency_rows(known), "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))
    return {known.words[r["word"]]: r["n"] for r in rows.collect()}


class Index:
    """Postings of the notices' rarest words: (word) -> (notice, position)."""

    def __init__(self, notices: list[Notice], known: Vocabulary, frequency: dict[str, int], share: float):
        self.notices, self.share = notices, share
        self.words = [np.array([known.number[w] for w in n.words]) for n in notices]
        postings = []
        for t, notice in enumerate(notices):
            rarest = sorted(range(len(notice.words)), key=lambda i: (frequency.get(notice.words[i], 0), i))
            postings += [(known.number[notice.words[i]], t, i) for i in rarest[:notice.indexed(share)]]
        table = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.notice, self.position = table[:, 1], table[:, 2]
        self.first = np.searchsorted(table[:, 0], np.arange(len(known.words) + 1))
        self.votes = np.array([min(2, n.indexed(share)) for n in notices], np.int64)

    def places(self, own: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(notice, text, start) of places where enough rare words agree; a start may lie before the text."""
        at = np.flatnonzero(own >= 0)
        n = self.first[own[at] + 1] - self.first[own[at]]
        at, n = at[n > 0], n[n > 0]
        posting = ragged(self.first[own[at]], n)
        doc = np.repeat(np.searchsorted(begin, at, side="right") - 1, n)
        start = np.repeat(at, n) - self.position[posting]
        met = np.stack([self.notice[posting], doc, start], axis=1)
        if not len(met):
            return tuple(np.zeros((3, 0), np.int64))
        met, votes = np.unique(met, axis=0, return_counts=True)
        return tuple(met[votes >= self.votes[met[:, 0]]].T)

    def verified(self, own: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, notice, share) of the places that bear the notice."""
        notice, doc, start = self.places(own, begin)
        found = []
        for t in np.unique(notice):
            want, mine = self.words[t], np.flatnonzero(notice == t)
            must = list(self.notices[t].mandatory)
            for a in range(0, len(mine), VERIFY_ROWS):
                part = mine[a:a + VERIFY_ROWS]
                at = start[part][:, None] + np.arange(len(want))
                inside = (at >= begin[doc[part]][:, None]) & (at < begin[doc[part] + 1][:, None])
                same = inside & (own[np.where(inside, at, 0)] == want)
                good = same[:, must].all(axis=1) & (same.sum(axis=1) >= self.notices[t].needed(self.share))
                found.append((doc[part][good], np.full(good.sum(), t), same.mean(axis=1)[good]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))


def phrase_starts(own: np.ndarray, begin: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the words of the phrase stand in a row inside one text."""
    last = len(phrase) - 1
    at = np.flatnonzero(own[:len(own) - last] == phrase[0]) if len(own) > last else np.zeros(0, np.int64)
    for i in range(1, len(phrase)):
        at = at[own[at + i] == phrase[i]]
    return at[np.searchsorted(begin, at, side="right") == np.searchsorted(begin, at + last, side="right")]


_RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double")


def _scan_rows(index: Index, known: Vocabulary, phrases: dict[str, str]):
    numbered = [(np.array([known.number[w] for w in p.split()]), label) for p, label in phrases.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for own, begin in _numbered(batch.column(1), known):
                n = len(begin) - 1
                base = np.zeros(n, np.int64)
                low, high = np.full(n, len(own), np.int64), np.full(n, -1, np.int64)
                base_labels: dict[int, set[str]] = {}
                for phrase, label in numbered:
                    at = phrase_starts(own, begin, phrase)
                    doc = np.searchsorted(begin, at, side="right") - 1
                    base += np.bincount(doc, minlength=n)
                    np.minimum.at(low, doc, at - begin[doc])
                    np.maximum.at(high, doc, at - begin[doc])
                    for d in np.unique(doc).tolist():
                        base_labels.setdefault(d, set()).add(label)
                labels = {d: set(x) for d, x in base_labels.items()}
                score = np.where(base > 0, 1.0, 0.0)
                for d, t, share in zip(*[x.tolist() for x in index.verified(own, begin)]):
                    labels.setdefault(d, set()).add(index.notices[t].label)
                    score[d] = max(score[d], share)
                none = base == 0
                for column, value in zip(out, (
                        np.diff(begin).tolist(), base.tolist(),
                        [None if x else y for x, y in zip(none, low.tolist())],
                        [None if x else y for x, y in zip(none, high.tolist())],
                        [",".join(sorted(base_labels.get(d, ()))) for d in range(n)],
                        [",".join(sorted(labels.get(d, ()))) for d in range(n)], score.tolist())):
                    column += value
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                  names=[part.split()[0] for part in _RESULT.split(", ")])
    return run


def scan(docs: DataFrame, notices: tuple[tuple[str, str, str], ...] = NOTICES,
         phrases: dict[str, str] = PHRASES, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a phrase stands, else the best share of a notice's words that was verified, else 0.
    """
    made = [Notice.of(*n) for n in notices]
    known = vocabulary(made, phrases)
    index = Index(made, known, frequencies(docs, known), share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_scan_rows(index, known, phrases), _RESULT)
