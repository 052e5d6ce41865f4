"""Quality rules: repetition coverage of texts by rolling n-gram hashes.

A text is a sequence of words, maximal runs outside ASCII white space. Word
sequences of a batch become integer ids, and the hash of each (n+1)-gram is
rolled from that of the n-gram at the same place, so one numpy pass per length
finds all repeated n-grams. A place whose n-gram is unique cannot start a
repeated (n+1)-gram, so each length only looks at what the last one left.

Defined results: a null or empty text has no words, all counts are 0 and it
fails the base rule; repeated rows and ids are judged each by themselves; other
columns are ignored by `measure` and passed through by `keep`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
_BASE_WINDOW = 5


@dataclass(frozen=True)
class QualityRules:
    """Per cents of word characters above which a text is rejected.

    top_percent: characters in all places of the n-gram that covers the most,
    among those that occur three times or more (a short text may repeat a line).
    dup_percent: characters inside n-grams seen earlier in the text.
    line_percent: bytes of lines seen earlier, of all lines' bytes.
    """

    min_words: int = 10
    repeat_percent: int = 20
    top_percent: dict[int, int] = field(default_factory=lambda: {2: 40, 3: 36, 4: 32})
    dup_percent: dict[int, int] = field(default_factory=lambda: {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20})
    line_percent: int = 40


MEASURE_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_percent double, worst_ngram int, worst_percent double, kept boolean"
)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64 scrambled bits for each integer."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in an n-word window at one of the starts."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def measure_texts(texts: list[bytes | None], rules: QualityRules) -> dict[str, np.ndarray]:
    """The columns of MEASURE_SCHEMA but doc_id, for a list of UTF-8 texts."""
    texts = [t or b"" for t in texts]
    docs = len(texts)
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, docs)
    lookup: dict[bytes, int] = defaultdict(count().__next__)
    total = int(n_words.sum())
    ids = np.fromiter(map(lookup.__getitem__, chain.from_iterable(split)), np.int64, total)
    length = np.fromiter((len(w.translate(None, _NOT_COUNTED)) for w in lookup), np.int64, len(lookup))
    chars = length[ids] if total else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(docs), n_words)
    after = np.cumsum(n_words)[doc] if total else np.zeros(0, np.int64)  # end of the word's text
    per_doc = lambda weights: np.bincount(doc, weights, docs).astype(np.int64)
    word_chars = per_doc(chars)

    line_dups, line_bytes, line_all = np.zeros((3, docs), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        line_dups[i] = len(lines) - len(distinct := set(lines))
        if line_dups[i]:
            line_all[i] = sum(map(len, lines))
            line_bytes[i] = line_all[i] - sum(map(len, distinct))

    word_hash, ends = _mixed(ids), np.concatenate([[0], np.cumsum(chars)])
    rolled, at = word_hash ^ _mixed(doc + (1 << 40)), np.arange(total)
    repeat_words = np.zeros(docs, np.int64)
    worst, worst_n = np.zeros(docs), np.zeros(docs, np.int32)
    failed = np.zeros(docs, bool)
    for n in range(2, max([*rules.top_percent, *rules.dup_percent, _BASE_WINDOW]) + 1):
        fits = at + n <= after[at]
        at = at[fits]
        rolled = rolled[fits] * np.uint64(0x9FB21C651E98DF25) + word_hash[at + n - 1]
        order = np.argsort(rolled, kind="stable")  # places of equal hash stay in order
        at, rolled = at[order], rolled[order]
        same = rolled[1:] == rolled[:-1]
        for k in range(n if n == _BASE_WINDOW else 0):  # exact where the count is a contract
            same &= ids[at[1:] + k] == ids[at[:-1] + k]
        same = np.concatenate([[False], same, [False]])[: len(at) + 1]
        first, later = ~same[:-1] & same[1:], same[:-1]
        if n in rules.top_percent and len(at):
            group = np.cumsum(~same[:-1]) - 1
            size = np.bincount(group)
            lead = np.flatnonzero(~same[:-1])
            covers = np.where(size > 2, size * (ends[at[lead] + n] - ends[at[lead]]), 0)
            most = np.zeros(docs, np.int64)
            np.maximum.at(most, doc[at[lead]], covers)
            bad, limit = most, rules.top_percent[n]
        elif n in rules.dup_percent:
            bad, limit = per_doc(chars * _covered(at[later], n, total)), rules.dup_percent[n]
        else:
            bad, limit = None, 0
        if n == _BASE_WINDOW:
            repeat_words = per_doc(_covered(at[first | later], n, total).astype(np.int64))
        if bad is not None:
            share = 100.0 * bad / np.maximum(word_chars, 1)
            failed |= 100 * bad > limit * word_chars
            worst_n[share > worst] = n
            worst = np.maximum(worst, share)
        keep = first | later
        at, rolled = at[keep], rolled[keep]
    failed |= 100 * line_bytes > rules.line_percent * line_all
    base = (n_words < rules.min_words) | (100 * repeat_words > rules.repeat_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.fromiter((len(t) - len(t.translate(None, _SYMBOLS)) for t in texts), np.int64, docs),
        "n_dup_lines": line_dups,
        "n_repeat_words": repeat_words,
        "base_failed": base,
        "dup_line_percent": 100.0 * line_bytes / np.maximum(line_all, 1),
        "worst_ngram": worst_n,
        "worst_percent": worst,
        "kept": ~base & ~failed,
    }


def measure(docs: DataFrame, rules: QualityRules = QualityRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of measures and verdicts per document (MEASURE_SCHEMA); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                found = measure_texts(texts, rules)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, MEASURE_SCHEMA)


def keep(docs: DataFrame, rules: QualityRules = QualityRules(), text_column: str = "text") -> DataFrame:
    """The rows of docs whose text passes, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, text_column):
                yield part.filter(pa.array(measure_texts(texts, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
