"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and the first four to six bytes of each word,
lower-cased (stems carry the signal in inflected languages). Counts over the
sample's documents give each feature's smoothed log odds; the strongest become
the sparse feature space. Labels say toxic or not; a toxic document's severity
grade follows from how many of its words are strong toxic features (weak
supervision), so grades are 0 (clean) to GRADES - 1.

The model is P(grade > k) = sigmoid(w.x - t_k): one weight vector shared by all
ordered thresholds t_1 < ... < t_K, fitted by gradient descent on a bounded
sample of labelled rows: the `sample_rows` of each class whose ids have the
smallest hashes (documented parameter). Only these labels are broadcast, so no
text but the sample's is shuffled; of documents that share an id one stands for it.
Prediction is one pass without shuffle over all documents and
gives the probability of each grade and the expected severity.

Defined results: a null or empty text has no features and gets the severity of
an empty text, which is not toxic; without any toxic label nothing is toxic;
several labels of a document count as several labelled rows, and several documents
of one id as the one of smallest text hash; labels without a document and null labels are ignored; repeated rows give repeated results; other
columns are ignored by `predict` and passed through by `keep`.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, settled

#: Features kept, by strength.
FEATURES = 8192
#: Labelled rows of either class in the fitting sample, at most.
SAMPLE_ROWS = 12_000
#: Partitions of the sample, which would else be few.
SAMPLE_PARTS = 48
#: Severity grades; documents with at least 1, 2, 4 strong words have grades 1, 2, 3.
GRADES, GRADE_WORDS = 4, (1, 2, 4)
#: Documents with a feature at least, for it to count.
LEAST_DOCUMENTS = 5
_STEMS = (4, 5, 6)

PREDICT_SCHEMA = "doc_id long, severity double, grade int, toxic_probability double, n_strong long, toxic boolean, kept boolean"

_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def stems(word: bytes) -> list[bytes]:
    """A word's features: itself, and its beginnings, marked by a dash, where it is longer than they are."""
    return [word, *(word[:n] + b"-" for n in _STEMS if len(word) > n)]


def feature_counts(labelled: DataFrame) -> DataFrame:
    """Rows (feature, toxic, clean) with the numbers of labelled documents that have a feature; null feature: all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])
            counts[0].clear(), counts[1].clear()
            return out

        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    own = counts[1 if toxic else 0]
                    own[None] += 1
                    own.update({f for w in set(words(text)) for f in stems(w)})
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield flush()
        yield flush()

    found = labelled.select("text", "toxic").mapInArrow(run, "feature binary, toxic long, clean long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Scale:
    """A fitted model: features, which of them are strong toxic ones, weights and thresholds."""

    def __init__(self, features: list[bytes], strong: np.ndarray):
        self.at = {f: i for i, f in enumerate(features)}
        self.strong = strong
        self.weights = np.zeros(len(features))
        self.thresholds = np.arange(1, GRADES) * 2.0

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' features as (text, feature, weight 1 + log(count) / 4), by text, and each text's number of strong words."""
        split = [words(t) for t in texts]
        number: dict[bytes, int] = defaultdict(count().__next__)
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        get = self.at.get
        own = [[i for f in stems(w) if (i := get(f)) is not None] for w in number]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        strong_word = np.array([bool(o) and bool(self.strong[o].any()) for o in own], bool)
        doc = np.repeat(np.arange(len(split)), n)
        strong = np.bincount(doc[strong_word[ids]], minlength=len(split)) if len(ids) else np.zeros(len(split), np.int64)
        hit = np.flatnonzero(size[ids] > 0) if len(ids) else np.zeros(0, np.int64)
        each = size[ids[hit]]
        place = np.repeat(begin[ids[hit]], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        keys, counts = np.unique(np.repeat(doc[hit], each) * max(1, len(self.at)) + flat[place], return_counts=True)
        return keys // max(1, len(self.at)), keys % max(1, len(self.at)), 1 + 0.25 * np.log(counts), strong

    def sums(self, doc: np.ndarray, at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(doc, x * self.weights[at], size) if len(at) else np.zeros(size)

    def grades(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of the grades (a column each) for sums z."""
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))
        edges = np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))])
        return edges[:, :-1] - edges[:, 1:]

    def fit(self, doc: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.1, penalty: float = 5e-4) -> None:
        """Adam steps on the weighted log likelihood; thresholds stay ordered, as a first one and positive gaps."""
        cut = np.concatenate([[1.0], np.full(GRADES - 2, 0.5)])  # first threshold, logs of gaps
        both = np.concatenate([self.weights, cut])
        m, v = np.zeros_like(both), np.zeros_like(both)
        for t in range(1, rounds + 1):
            w, cut = both[: len(self.weights)], both[len(self.weights) :]
            thresholds = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
            z = np.bincount(doc, x * w[at], len(grade))
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds, -40, 40)))
            edges = np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))])
            pick = np.arange(len(z))
            hi, lo = edges[pick, grade], edges[pick, grade + 1]
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
            dz = d_hi - d_lo
            dt = np.array([-d_hi[grade == k + 1].sum() + d_lo[grade == k].sum() for k in range(GRADES - 1)])
            back = np.cumsum(dt[::-1])[::-1]  # each gap moves all later thresholds
            gradient = np.concatenate([np.bincount(at, x * dz[doc], len(w)) / weight.sum() - penalty * w, back * np.concatenate([[1.0], np.exp(cut[1:])]) / weight.sum()])
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            both = both + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, cut = both[: len(self.weights)], both[len(self.weights) :]
        self.thresholds = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_features: int = FEATURES, id_column: str = "doc_id", text_column: str = "text") -> Scale:
    """Fit features, weights and thresholds on a bounded sample of labelled documents."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    first = [own.where(side).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows) for side in (F.col("toxic"), ~F.col("toxic"))]
    sample = settled(first[0].unionAll(first[1]))  # at most 2 * sample_rows narrow rows
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    one = texts.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    labelled = settled(one.join(F.broadcast(sample), "doc_id").select("text", "toxic").repartition(SAMPLE_PARTS))  # at most 2 * sample_rows texts
    counts = settled(feature_counts(labelled))
    n = counts.where("feature IS NULL").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean")).first()
    if not n["toxic"]:
        return Scale([], np.zeros(0, bool))
    odds = F.log((F.col("toxic") + 0.5) / (n["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (n["clean"] + 1.0))
    top = counts.where(F.col("feature").isNotNull() & (F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS)).withColumn("odds", odds)
    strength = F.abs("odds") * F.sqrt(F.greatest(F.col("toxic") / n["toxic"], F.col("clean") / max(1, n["clean"])))
    top = top.orderBy(F.desc(strength), "feature").limit(max_features).collect()  # at most max_features rows
    model = Scale([bytes(r["feature"]) for r in top], np.array([r["odds"] > 3.0 for r in top], bool))

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own_texts in byte_slices(batch, "text"):
                doc, at, x, strong = sent.value.features(own_texts)
                edges = pa.array(np.searchsorted(doc, np.arange(len(own_texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.ListArray.from_arrays(edges, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(x)), pa.array(strong, pa.int64())], names=["toxic", "at", "x", "strong"])

    found = labelled.mapInArrow(extract, "toxic boolean, at array<int>, x array<double>, strong long").toArrow().combine_chunks()  # at most 2 * sample_rows sparse rows
    toxic, strong = np.array(found.column("toxic").to_pylist(), bool), np.array(found.column("strong").to_pylist(), np.int64)
    if not len(toxic) or not model.at:
        return model
    at, x = (found.column(c).combine_chunks() for c in ("at", "x"))
    doc = np.repeat(np.arange(len(toxic)), np.asarray(at.value_lengths()))
    grade = np.where(toxic, np.clip(np.searchsorted(GRADE_WORDS, strong, side="right"), 1, GRADES - 1), 0)
    balance = np.where(toxic, len(toxic) / (2 * max(1, toxic.sum())), len(toxic) / (2 * max(1, (~toxic).sum())))
    model.fit(doc, np.asarray(at.flatten(), np.int64), np.asarray(x.flatten(), np.float64), grade, balance)
    return model


def _columns(model: Scale, texts: list[bytes | None], threshold: float) -> dict[str, pa.Array]:
    doc, at, x, strong = model.features(texts)
    p = model.grades(model.sums(doc, at, x, len(texts)))
    toxic = 1 - p[:, 0] >= threshold
    return {
        "severity": pa.array(p @ np.arange(GRADES)),
        "grade": pa.array(np.argmax(p, axis=1).astype(np.int32)),
        "toxic_probability": pa.array(1 - p[:, 0]),
        "n_strong": pa.array(strong, pa.int64()),
        "toxic": pa.array(toxic),
        "kept": pa.array(~toxic),
    }


def predict(docs: DataFrame, model: Scale, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document (PREDICT_SCHEMA); toxic where P(grade > 0) reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                found = _columns(sent.value, texts, threshold)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found.values()], names=["doc_id", *found])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PREDICT_SCHEMA)


def keep(docs: DataFrame, model: Scale, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, all columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, text_column):
                yield part.filter(_columns(sent.value, texts, threshold)["kept"])

    return docs.mapInArrow(run, docs.schema)
