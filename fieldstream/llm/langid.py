"""Language identification by hierarchical discrimination.

A first level predicts the language family, a second level the language within
it. Both use linear support vector machines on hashed byte n-grams of the whole
text (letters in lower case, all else one blank): one against the rest between
families, one against one between the languages of a family. Languages whose
code is in no listed family form families of their own.

Training takes a bounded sample of labelled rows, about `per_language` documents
of each language by a hash of id and text, and about `machine_rows` rows of each
machine, its own side whole (documented parameters); the machines are trained in
parallel, one group of rows each. Prediction is one pass without shuffle over all
documents, and reads nothing but the text; a long text is summed up in pieces.

Defined results: a null text, or one without a letter, is `und` with score 0, as
is every text when no labelled document exists; repeated rows give repeated
results; null ids are never held out; bytes that are no UTF-8 are n-grams as they are,
and no letters; more than MAX_LANGUAGES languages are an error, not a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, fold, settled

#: Hash buckets of features.
BUCKETS = 1 << 15
#: Labelled documents of each language in the training sample, on average.
PER_LANGUAGE = 1500
#: Rows of a machine's sample on average, where it tells a language or family from many others.
MACHINE_ROWS = 12_000
#: Languages at most: machines of all pairs of a family go to all tasks.
MAX_LANGUAGES = 200
#: Bytes whose features are in memory at once.
PIECE_BYTES = 1 << 20

PREDICT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, family string"

# Language codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}

_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
_GAP = b"    "
_SPREAD = (2654435761, 2246822519, 3266489917, 668265263)
_SCALE = 20.0


def family(language: str) -> str:
    return _FAMILY.get(language.lower().replace("_", "-").split("-")[0], language)


def buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """Feature buckets of the byte 1-, 2-, 3- and 4-grams at each place but the last three."""
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    gram = np.zeros(len(data) - 3, np.uint32)
    for n, spread in enumerate(_SPREAD):
        gram |= data[n : len(data) - 3 + n].astype(np.uint32) << np.uint32(8 * n)
        yield ((gram * np.uint32(spread) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> shift).astype(np.intp)


def folded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, folded, each followed by blanks, and where each starts."""
    parts = [(t or b"").translate(_FOLD) + _GAP for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of one text; the weights of each n sum to a constant."""
    data, _ = folded([text])
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data) - 3, PIECE_BYTES):
        for b in buckets(data[at : at + PIECE_BYTES + 3]):
            counts += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (_SCALE * counts[at] / (len(data) - 3)).astype(np.float32)


def margins(texts: list[bytes | None], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The machines' margins for each text; weights has a row for each bucket."""
    data, starts = folded(texts)
    sums = np.zeros((len(starts), weights.shape[1]))
    across = (starts[1:, None] - np.arange(3, 0, -1)).ravel()  # places whose n-grams would reach into the next text
    for at in range(0, len(data) - 3, PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES + 3]
        total = np.zeros((len(piece) - 3, weights.shape[1]), np.float32)
        for b in buckets(piece):
            total += weights[b]
        total[across[np.searchsorted(across, at) : np.searchsorted(across, at + len(total))] - at] = 0
        first = np.searchsorted(starts, at, side="right") - 1  # texts that have bytes in the piece
        own = np.append(at, starts[first + 1 : np.searchsorted(starts, at + len(total))]) - at
        sums[first : first + len(own)] += np.add.reduceat(total, own, axis=0, dtype=np.float64)
    length = np.diff(np.append(starts, len(data))) - 3
    return _SCALE * sums / length[:, None] + bias


def fit_machine(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, epochs: int = 12, c: float = 1.0, seed: int = 1) -> np.ndarray:
    """Weights and bias (last) of an L2-regularised hinge-loss machine, by dual coordinate descent."""
    w, alpha, rng = np.zeros(BUCKETS + 1), np.zeros(len(y)), np.random.default_rng(seed)
    norm = np.array([float(v @ v) + 1.0 for v in x])
    share = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[at[i]] @ x[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at[i]] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, machine_rows: int = MACHINE_ROWS, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", least: int = 1) -> dict:
    """The model: machines' names and weights. Learns from rows outside fold 0 with a language that `least` of them have."""
    labelled = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(language_column).cast("string").alias("lang")).where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = labelled.groupBy("lang").count().where(F.col("count") >= least).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages have {least} labelled documents")
    counts = {r["lang"]: r["count"] for r in found}
    languages = sorted(counts)
    jobs = [("family", f, "") for f in sorted({family(x) for x in languages})]
    jobs = [] if len(jobs) < 2 else jobs
    jobs += [("pair", a, b) for a, b in combinations(languages, 2) if family(a) == family(b)]
    if not languages:
        return {"languages": [], "jobs": [], "weights": np.zeros((BUCKETS + 1, 0), np.float32)}
    use = {x: [i for i, (kind, a, b) in enumerate(jobs) if kind == "family" or x in (a, b)] for x in languages}
    rate = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / counts[x]))])
    many = sum(min(per_language, n) for n in counts.values())
    other_rate = min(1.0, machine_rows / max(1, many))  # of the rows of other families
    jobs_of = [(i, 1.0 if jobs[i][0] == "pair" or family(x) == jobs[i][1] else other_rate) for x in languages for i in use[x]]
    cut = np.cumsum([0, *(len(use[x]) for x in languages)]).tolist()
    machine = lambda j: F.struct(F.lit(j[0]).alias("job"), F.lit(j[1]).alias("rate"))
    machines = F.create_map(*[v for x, a, b in zip(languages, cut, cut[1:], strict=False) for v in (F.lit(x), F.array(*map(machine, jobs_of[a:b])))])
    share = lambda seed, *columns: F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / float(1 << 53)
    sample = labelled.where(share(11, "doc_id", "text") < rate[F.col("lang")])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in byte_slices(batch, "text"):
                found = [features(t or b"") for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["lang", "at", "x"])

    sample = settled(sample.select("lang", "text").mapInArrow(extract, "lang string, at array<int>, x array<float>"))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        job = int(rows["job"].iloc[0])
        kind, a, _ = jobs[job]
        y = np.array([1.0 if (family(x) if kind == "family" else x) == a else -1.0 for x in rows["lang"]])
        return pd.DataFrame({"job": [job], "w": [fit_machine(list(rows["at"]), list(rows["x"]), y).astype(np.float32).tobytes()]})

    weights = np.zeros((BUCKETS + 1, len(jobs)), np.float32)
    for r in sample.withColumn("machine", F.explode(machines[F.col("lang")])).where(share(13, "at", "x", "machine.job") < F.col("machine.rate")).select("lang", "at", "x", "machine.job").groupBy("job").applyInPandas(train, "job int, w binary").collect() if jobs else []:
        weights[:, r["job"]] = np.frombuffer(r["w"], np.float32)
    return {"languages": languages, "jobs": jobs, "weights": weights}


def predict_texts(model: dict, texts: list[bytes | None]) -> tuple[list[str], list[float], list[str]]:
    """Language, score and family of each text."""
    languages, jobs, weights = model["languages"], model["jobs"], model["weights"]
    m = margins(texts, weights[:-1], weights[-1].astype(np.float64)) if jobs else np.zeros((len(texts), 0))
    sure = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
    families = sorted({family(x) for x in languages})
    heads = np.array([i for i, j in enumerate(jobs) if j[0] == "family"], int)
    head = np.argmax(m[:, heads], axis=1) if len(heads) else np.zeros(len(texts), int)
    head_score = sure[np.arange(len(texts)), heads[head]] if len(heads) else np.ones(len(texts))
    best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    for f, name in enumerate(families):
        rows = np.flatnonzero(head == f)
        own = [x for x in languages if family(x) == name]
        votes = np.zeros((len(rows), len(own)))
        for i, (kind, a, b) in enumerate(jobs):
            if kind == "pair" and a in own:
                votes[:, own.index(a)] += sure[rows, i]
                votes[:, own.index(b)] += 1 - sure[rows, i]
        pick = np.argmax(votes, axis=1)
        best[rows] = np.array(own, object)[pick]
        score[rows] = head_score[rows] * (votes[np.arange(len(rows)), pick] / (len(own) - 1) if len(own) > 1 else 1.0)
    none = np.array([not languages or not t or not _LETTER.search(t.decode(errors="replace")) for t in texts])
    best[none], score[none] = "und", 0.0
    return best.tolist(), score.tolist(), [None if x == "und" else family(x) for x in best]


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document (PREDICT_SCHEMA)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages and machines only; does not grow with the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text", 1 << 20):
                best, score, families = predict_texts(sent.value, texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(families, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "family"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", ((fold() == 0) & F.col("doc_id").isNotNull()).alias("held_out"), "text")
    return rows.mapInArrow(run, PREDICT_SCHEMA)
