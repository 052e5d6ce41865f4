"""License scans by a positional index of rare tokens.

Texts of well-known licences, whole where they are short, and the notices by which
others are announced, are indexed by word: each word has postings (template,
position). One pass counts in how many documents each indexed word stands (the
vocabulary is small, so these counts are few). A second pass looks up each
document's rare indexed words, turns every (place in the document, posting) into a
relative position, and intersects the postings that agree on it, so that no licence
takes another's place: a template whose rare words stand at the same distances is a
candidate. It becomes a label when its mandatory key phrases stand, word for word,
near the place where it aligns. Alignments are found window by window, so that
memory does not grow with the text beyond its words.

Beside these, `base` phrases are found at every place where their words stand
consecutively.

Defined results: a null text counts as empty; without words there are no labels,
first and last word are null and the score is 0; repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Words of a document whose alignments are looked at together.
WINDOW = 1 << 14

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SCAN_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Template:
    """A passage, and the phrases of it that must stand word for word."""

    label: str
    passage: str
    key_phrases: tuple[str, ...]


# Phrases and labels of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_AS_IS = "the software is provided as is without warranty of any kind express or implied"
_NO_LIABILITY = "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_LISTS = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_FREE_SOFTWARE = "you can redistribute it and or modify it under the terms of the gnu"
_PUBLISHED = "as published by the free software foundation either version"

# Texts and notices of public licences.
TEMPLATES = (
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template(
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        f"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_AS_IS} including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement {_NO_LIABILITY}",
        ("to deal in the software without restriction", "this permission notice shall be included in all copies or substantial portions"),
    ),
    Template("apache", "licensed under the apache license version 2 0", ("licensed under the apache license",)),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("agreed to in writing", "without warranties or conditions of any kind")),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "www apache org licenses")),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", f"this program is free software {_FREE_SOFTWARE} general public license as published by the free software foundation", ("terms of the gnu general public license",)),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "see the gnu general public license")),
    Template("lgpl", f"this library is free software {_FREE_SOFTWARE} lesser general public license {_PUBLISHED}", ("terms of the gnu lesser general public license",)),
    Template("agpl", f"this program is free software {_FREE_SOFTWARE} affero general public license {_PUBLISHED}", ("terms of the gnu affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("under cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("bsd", _BSD_HEAD, ("redistribution and use in source and binary forms",)),
    Template("bsd", f"{_BSD_HEAD} 1 {_BSD_LISTS} 2 {_BSD_BINARY}", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template(
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        ("procurement of substitute goods or services", "even if advised of the possibility of such damage"),
    ),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template(
        "isc",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("disclaims all warranties with regard to this software", "other tortious action"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ("permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented"),
    ),
    Template("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", ("any person or organization obtaining a copy", "use reproduce display distribute execute and transmit")),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("free and unencumbered software released into the public domain",)),
)


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text in lower case."""
    return text.translate(_FOLD).split()


class Index:
    """Postings of the templates' words, and the integer forms of all phrases."""

    def __init__(self, templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]):
        passages = [words(t.passage.encode()) for t in templates]
        phrases = [[words(p.encode()) for p in t.key_phrases] for t in templates]
        base_words = [(words(p.encode()), label) for p, label in base]
        self.vocabulary = sorted({*chain(*passages), *chain(*chain(*phrases)), *chain(*(p for p, _ in base_words))})
        self.ids = {w: i for i, w in enumerate(self.vocabulary)}
        number = lambda ws: np.array([self.ids[w] for w in ws], np.int32)
        self.labels = [t.label for t in templates]
        self.passages = [number(p) for p in passages]
        self.keys = [[number(p) for p in ps] for ps in phrases]
        self.base = [(number(p), label) for p, label in base_words]
        flat = np.concatenate(self.passages)
        order = np.argsort(flat, kind="stable")  # postings by word: template and position
        self.templates = np.repeat(np.arange(len(self.passages)), list(map(len, self.passages)))[order]
        self.places = np.concatenate([np.arange(len(p)) for p in self.passages])[order]
        self.n_postings = np.bincount(flat, minlength=len(self.vocabulary))
        self.first_posting = np.cumsum(self.n_postings) - self.n_postings

    def numbered(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts with -1 for other words and -2 after each text, and where each text starts."""
        look, split = self.ids.get, [words(t or b"") for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in split])]).astype(np.int64)
        flat = np.empty(int(starts[-1]), np.int32)
        for s, at in zip(split, starts, strict=False):
            flat[at : at + len(s)] = [look(w, -1) for w in s]
            flat[at + len(s)] = -2
        return flat, starts


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase stands in ids."""
    hits = np.flatnonzero(ids == phrase[0])
    for k, w in enumerate(phrase[1:].tolist(), 1):
        hits = hits[hits + k < len(ids)]
        hits = hits[ids[hits + k] == w]
    return hits


def aligned(index: Index, idf: np.ndarray, rare: np.ndarray, ids: np.ndarray, rare_words: int, least: float, slack: int) -> tuple[set[str], float]:
    """Labels and the best score of one document, from its rare words."""
    at = np.flatnonzero(np.concatenate([rare, [False, False]])[ids])
    single = len(np.unique(ids[at])) == 1
    longest = max(map(len, index.passages))
    whole = np.array([sum(sorted((idf[w] for w in set(p.tolist()) if rare[w]), reverse=True)[:rare_words]) for p in index.passages])
    labels, best = set(), 0.0
    for begin in range(-longest, len(ids), WINDOW):  # alignments that start in [begin, begin + WINDOW)
        here = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + WINDOW + longest)]
        word = ids[here]
        n = index.n_postings[word]
        if not n.any():
            continue
        posting = np.repeat(index.first_posting[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        start = np.repeat(here, n) - index.places[posting]
        inside = (start >= begin) & (start < begin + WINDOW)
        agreed = np.unique((index.templates[posting][inside] * (WINDOW + 1) + start[inside] - begin) * len(index.vocabulary) + np.repeat(word, n)[inside])
        key, which = np.unique(agreed // len(index.vocabulary), return_inverse=True)
        template, start = key // (WINDOW + 1), key % (WINDOW + 1) + begin
        score = np.bincount(which, idf[agreed % len(index.vocabulary)]) / whole[template] if len(key) else np.zeros(0)
        likely = np.flatnonzero((score >= least) & ((np.bincount(which) >= 2) | single)) if len(key) else np.zeros(0, np.int64)
        for i in likely[np.argsort(-score[likely], kind="stable")].tolist():
            t, s = int(template[i]), int(start[i])
            if index.labels[t] in labels and score[i] <= best:
                continue
            near = ids[max(0, s - slack) : s + len(index.passages[t]) + slack]
            if all(len(places(near, key)) for key in index.keys[t]):
                labels.add(index.labels[t])
                best = max(best, min(1.0, float(score[i])))
    return labels, best


def scan_texts(index: Index, idf: np.ndarray, rare: np.ndarray, texts: list[bytes | None], rare_words: int, least: float, slack: int) -> dict[str, list]:
    """The columns of SCAN_SCHEMA but doc_id."""
    flat, starts = index.numbered(texts)
    n = np.diff(starts) - 1
    docs = len(texts)
    n_base, first, last = np.zeros(docs, np.int64), np.full(docs, np.iinfo(np.int64).max), np.full(docs, -1)
    base: list[set[str]] = [set() for _ in range(docs)]
    for phrase, label in index.base:
        hits = places(flat, phrase)
        doc = np.searchsorted(starts, hits, side="right") - 1
        np.add.at(n_base, doc, 1)
        np.minimum.at(first, doc, hits - starts[doc])
        np.maximum.at(last, doc, hits - starts[doc])
        for d in np.unique(doc).tolist():
            base[d].add(label)
    flagged = np.flatnonzero(np.concatenate([rare, [False, False]])[flat])  # ids -1 and -2 are no indexed words
    anchors = np.unique(np.searchsorted(starts, flagged, side="right") - 1)
    labels, scores = [set(b) for b in base], np.zeros(docs)
    for d in anchors.tolist():
        found, scores[d] = aligned(index, idf, rare, flat[starts[d] : starts[d] + n[d]], rare_words, least, slack)
        labels[d] |= found
    scores = np.where((n_base > 0) & (scores == 0), 0.5, scores)
    return {
        "n_words": n.tolist(),
        "n_base": n_base.tolist(),
        "first_word": [int(x) if c else None for x, c in zip(first, n_base, strict=True)],
        "last_word": [int(x) if c else None for x, c in zip(last, n_base, strict=True)],
        "base_labels": [",".join(sorted(b)) for b in base],
        "labels": [",".join(sorted(x)) for x in labels],
        "score": scores.tolist(),
    }


def document_counts(docs: DataFrame, index: Index, text_column: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each indexed word, over all documents."""
    size = len(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, texts in byte_slices(batch, "text"):
                flat, starts = index.numbered(texts)
                at = np.flatnonzero(flat >= 0)
                seen = np.unique((np.searchsorted(starts, at, side="right") - 1) * size + flat[at])
                counts += np.bincount(seen % size, minlength=size)
                total += len(texts)
        word = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *word.tolist()], pa.int32()), pa.array([total, *counts[word].tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a row for each indexed word
    counts, total = np.zeros(size, np.int64), 0
    for r in rows:
        if r["word"] < 0:
            total = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return total, counts


def rare_words_of(index: Index, idf: np.ndarray, least_idf: float) -> np.ndarray:
    """Which indexed words are looked up: those of at least that IDF, and the three of highest IDF of each template."""
    rare = idf >= least_idf
    for passage in index.passages:
        own = np.unique(passage)
        rare[own[np.lexsort((own, -idf[own]))][:3]] = True
    return rare


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, rare_words: int = 8, common_share: float = 0.1, least_score: float = 0.5, slack: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of labels a document (SCAN_SCHEMA).

    common_share: words in more than this share of documents are only looked up
    where a template has too few others; rare_words: words of a template whose IDF is its whole; least_score: share of
    that IDF that must agree on one relative position; slack: words around
    the aligned place in which the key phrases must stand.
    """
    index = Index(templates, base)
    total, counts = document_counts(docs, index, text_column)
    idf = np.array([math.log((total + 1) / (c + 1)) + 1e-3 for c in counts.tolist()])
    rare = rare_words_of(index, idf, -math.log(common_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                found = scan_texts(index, idf, rare, texts, rare_words, least_score, slack)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t) for v, t in zip(found.values(), types, strict=True))], names=["doc_id", *found])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCAN_SCHEMA)
