"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Tokens are lower-cased words and one end a document. The base model is the
smoothed unigram of the training documents. The maximum-entropy model predicts
each token's group from its history and keeps the unigram within the group:

    P(w | h) = P(class | h) * P(group | class, h) * (c(w) + 1/2) / mass(group)

with CLASSES classes of GROUPS groups. Frequent tokens are groups of their own,
the others share groups by their last SUFFIX bytes, which tell inflections and
languages apart, and unseen tokens are one group.
Both factors are softmaxes over hashed features of the history: the last word,
the last two, and two skips (the word before the last, and the one before that).
Without feature weights the model is the unigram.

1. One pass numbers the tokens of chunks of text, frequent ones first, and counts
   them by chunk; a window adds the counts up by token, so nothing that grows with
   the vocabulary is broadcast or collected.
2. Each chunk, one row of compressed token numbers, meets its tokens' counts and
   codes; documents get their base scores.
3. Training covers all training documents once, in ROUNDS slices: tasks run
   mini-batch gradient steps from the shared weights, and their changes are
   averaged by tokens. Weights have a fixed size. As usual with averaged steps,
   the weights depend a little on how the rows are cut into tasks; base scores and
   counts do not.
4. Scoring runs over all documents in sparse numpy batches.

Defined results: a null text counts as empty and has only its end; null ids are
training documents; without training tokens all scores are those of the uniform
unseen token; repeated rows count and are scored as often as they stand; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, fold, give_back, settled

CLASSES, GROUPS = 16, 16
#: Classes whose groups are single frequent tokens (the very first group is for unseen tokens).
SINGLE_CLASSES = 8
#: Hash buckets of features for the class and for the group in it.
CLASS_BUCKETS, GROUP_BUCKETS = 1 << 14, 1 << 12
FEATURES = 4
#: Last bytes of a token by which rarer tokens share groups.
SUFFIX = 2
#: Distinct tokens at which a chunk ends, and those that one document of it may have at most (they are numbered in 24 bits).
CHUNK_TOKENS, MAX_TOKENS = 1 << 22, 1 << 24
#: Text bytes of a chunk, and slices of the training documents.
CHUNK_BYTES, ROUNDS = 9 << 20, 3
STEP_TOKENS, RATE = 8192, 0.7
#: The end of a document; no word holds a line feed.
END = b"\n"

_SINGLES = SINGLE_CLASSES * GROUPS
_SHARED = CLASSES * GROUPS - _SINGLES
_ONES = np.ones(CLASSES, np.float32)
_MULTIPLY = (2654435761, 2246822519, 3266489917, 668265263)


def tokens(text: bytes | None) -> list[bytes]:
    out = (text or b"").lower().split()
    out.append(END)
    return out


_NUMBERED = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("local", pa.int32()), ("token", pa.binary()), ("n", pa.int64())])
_NUMBERED_SCHEMA = "chunk long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, ids binary, local int, token binary, n long"
_ENCODED_SCHEMA = "doc_ids array<long>, held_out array<boolean>, sizes array<int>, ids binary, codes binary, known array<long>, log_sum array<double>, tokens long, distinct long, top_codes array<long>, top_counts array<long>, shared_mass array<double>"
#: Pieces of a weight table in which tasks give it back, and their rows.
_PARTS = 8
_PART_SCHEMA = "part int, tokens double, weights binary"
_ZSTD = pa.Codec("zstd")


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane (small numbers leave empty planes)."""
    return _ZSTD.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T), asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 4 * size, asbytes=True), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def numbered(docs: DataFrame) -> DataFrame:
    """Chunks of documents as token numbers (one row with ids each), and each chunk's tokens with training counts (rows with a token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            if len(number) > MAX_TOKENS:
                raise ValueError(f"more than {MAX_TOKENS} distinct tokens in the documents of one chunk")
            chunk = TaskContext.get().partitionId() << 16 | next(serial)  # shifted by 24 bits it still fits in 63
            flat = np.concatenate([r[2] for r in rows])
            sizes = np.array([len(r[2]) for r in rows], np.int32)
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            flat = rank[flat].astype(np.int32)
            counts = np.bincount(flat[np.repeat(~np.array([r[1] for r in rows], bool), sizes)], minlength=len(number))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([packed(flat)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], schema=_NUMBERED)
            words = pa.array(number, pa.binary()).take(pa.array(order))
            for start in range(0, len(words), 50_000):
                n = min(50_000, len(words) - start)
                nulls = [pa.nulls(n, t) for t in (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk), pa.int64()), *nulls, pa.array(np.arange(start, start + n, dtype=np.int32)), words.slice(start, n), pa.array(counts[start : start + n], pa.int64())], schema=_NUMBERED)

        number: dict[bytes, int] = defaultdict(count().__next__)
        rows, held, serial = [], 0, count()
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                for doc_id, held_out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts, strict=True):
                    rows.append((doc_id, held_out, np.fromiter(map(number.__getitem__, tokens(text)), np.int32)))
                    held += len(text or b"")
                if held >= CHUNK_BYTES or len(number) >= CHUNK_TOKENS:
                    yield from close()
                    number = defaultdict(count().__next__)
                    rows, held = [], 0
                    give_back()
        if rows:
            yield from close()
        number.clear()
        rows.clear()
        give_back()

    return docs.mapInArrow(run, _NUMBERED_SCHEMA)


class Model:
    """Weights and masses; knows how to take gradient steps and to score."""

    def __init__(self, mass: np.ndarray):
        self.mass = np.maximum(mass, 1e-9)
        groups = self.mass.reshape(CLASSES, GROUPS)
        self.class_bias = np.log(groups.sum(axis=1) / groups.sum()).astype(np.float32)
        self.group_bias = np.log(groups / groups.max(axis=1, keepdims=True)).astype(np.float32)
        self.class_weights = np.zeros((CLASS_BUCKETS, CLASSES), np.float32)
        self.group_weights = np.zeros((GROUP_BUCKETS * CLASSES, GROUPS), np.float32)

    def features(self, words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Hashes of the history at each place; places before a text's start read as one marker."""
        place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
        back = []
        for n in (1, 2, 3):
            w = np.full(len(words), 0x3FFF01, np.uint32)
            w[n:] = np.where(place[n:] >= n, words[:-n], w[n:]) if len(words) > n else w[n:]
            back.append(w)
        one, two, three = back
        with_two = (one * np.uint32(_MULTIPLY[0])) ^ (two * np.uint32(_MULTIPLY[1]) + np.uint32(0x9E3779B9))
        return [(one + np.uint32(1)) * np.uint32(_MULTIPLY[0]), with_two * np.uint32(_MULTIPLY[2]), (two + np.uint32(7)) * np.uint32(_MULTIPLY[2]), (three + np.uint32(13)) * np.uint32(_MULTIPLY[3])]

    def steps(self, codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Mini-batches of the codes of texts one after another, with their features; only one at a time is held."""
        starts = np.cumsum(sizes) - sizes
        for k in range(0, len(codes), STEP_TOKENS):
            low = max(0, k - 3)  # the history of the first place
            words = codes[low : k + STEP_TOKENS].astype(np.uint32) & np.uint32(0x3FFF)
            inner = starts[np.searchsorted(starts, low, side="right") : np.searchsorted(starts, low + len(words))] - low
            yield codes[k : k + STEP_TOKENS], [h[k - low :] for h in self.features(words, np.append(0, inner))]

    def forward(self, hashed: list[np.ndarray], group: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
        """Rows of both weight tables, and the probabilities of classes and of the groups of the true class."""
        cls = (group // GROUPS).astype(np.intp)
        class_rows = [(h >> np.uint32(32 - 14)).astype(np.intp) for h in hashed]
        group_rows = [(h >> np.uint32(32 - 12)).astype(np.intp) * CLASSES + cls for h in hashed]
        out, part = [], np.empty((len(cls), CLASSES), np.float32)
        for z, rows, weights in ((np.repeat(self.class_bias[None, :], len(cls), axis=0), class_rows, self.class_weights), (self.group_bias.take(cls, axis=0), group_rows, self.group_weights)):
            for r in rows:
                z += weights.take(r, axis=0, out=part, mode="clip")  # rows are in range; this mode needs no copy
            np.minimum(np.maximum(z, -60, out=z), 60, out=z)  # biases are shares, so sums stay within what floats hold
            np.exp(z, out=z)
            z /= (z @ _ONES)[:, None]
            out.append(z)
        return class_rows, group_rows, *out

    def step(self, codes: np.ndarray, hashed: list[np.ndarray], rate: float) -> None:
        """One gradient step on a mini-batch; each row moves by its mean gradient, less where it has few examples."""
        group = codes >> 14
        class_rows, group_rows, p1, p2 = self.forward(hashed, group)
        at, part = np.arange(len(codes)), np.empty_like(p1)
        for rows, p, true, weights in ((class_rows, p1, group // GROUPS, self.class_weights), (group_rows, p2, group % GROUPS, self.group_weights)):
            g = np.negative(p, out=p)
            g[at, true] += 1
            for r in rows:
                short = r.astype(np.uint16)  # both tables have at most 2**16 rows, for which numpy sorts by radix
                order = np.argsort(short, kind="stable")
                sorted_rows = short.take(order)
                first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
                n = np.diff(np.append(first, len(r))).astype(np.float32)
                change = np.add.reduceat(g.take(order, axis=0, out=part, mode="clip"), first, axis=0)
                change *= (np.float32(rate / FEATURES) / (4 + n))[:, None]
                weights[sorted_rows.take(first)] += change

    def score(self, codes: np.ndarray, hashed: list[np.ndarray]) -> np.ndarray:
        """log10 P(class, group | history) - log10 mass(group) at each place."""
        group = codes >> 14
        _, _, p1, p2 = self.forward(hashed, group)
        at = np.arange(len(codes))
        p = p1[at, group // GROUPS].astype(np.float64) * p2[at, group % GROUPS]
        return np.log10(np.maximum(p, 1e-300)) - np.log10(self.mass)[group]


def _encoded(chunk, words):
    """A chunk's row with base sums and token codes, and sums over the tokens whose first row it holds."""
    packs = np.asarray(words.column("packed"), np.int64)  # local number, whether it is the token's first row, and its code
    local = np.argsort(packs)
    packs, counts = packs[local], np.asarray(words.column("c"), np.int64)[local]
    code = np.where(counts > 0, np.maximum(packs & 0xFFFFFFFF, 1), 0)
    sizes = np.asarray(chunk.column("sizes").combine_chunks().flatten())
    ids = unpacked(chunk.column("ids")[0].as_py(), int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    log_sum = np.add.reduceat(np.log10(counts + 0.5)[ids], starts)
    known = np.add.reduceat((counts[ids] > 0).astype(np.int64), starts)
    own = (packs >> 32 & 1 == 1) & (counts > 0)
    own_code, own_count = code[own], counts[own]
    most = np.lexsort((own_code, -own_count))[: 4 * _SINGLES]
    mass = np.bincount((own_code >> 14) % _SHARED, own_count + 0.5, _SHARED)
    out = pa.table(
        {
            "doc_ids": chunk.column("doc_ids"),
            "held_out": chunk.column("held_out"),
            "sizes": chunk.column("sizes"),
            "ids": chunk.column("ids"),
            "codes": pa.array([packed(code)], pa.binary()),
            "known": pa.array([known], pa.list_(pa.int64())),
            "log_sum": pa.array([log_sum], pa.list_(pa.float64())),
            "tokens": pa.array([int(own_count.sum())], pa.int64()),
            "distinct": pa.array([len(own_count)], pa.int64()),
            "top_codes": pa.array([own_code[most]], pa.list_(pa.int64())),
            "top_counts": pa.array([own_count[most]], pa.list_(pa.int64())),
            "shared_mass": pa.array([mass], pa.list_(pa.float64())),
        }
    )
    give_back()
    return out


def _masses(encoded: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, distinct ones, the codes of single-token groups and the masses of all groups; a fixed number of rows reaches the driver.

    A group is a function of a token's code, so tokens of one code share a group
    and the model stays normalised.
    """
    total, distinct = encoded.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    shared = encoded.select(F.posexplode("shared_mass").alias("at", "mass")).groupBy("at").agg(F.sum("mass").alias("mass")).collect()
    pairs = encoded.select(F.explode(F.arrays_zip("top_codes", "top_counts")).alias("t")).select("t.top_codes", "t.top_counts")
    top = pairs.groupBy("top_codes").agg(F.sum("top_counts").alias("c"), F.count("*").alias("n")).orderBy(F.desc("c"), "top_codes").limit(_SINGLES - 1).collect()
    mass = np.zeros(CLASSES * GROUPS)
    mass[0] = 0.5
    for r in shared:
        mass[_SINGLES + r["at"]] = r["mass"]
    for i, r in enumerate(top):
        own = r["c"] + 0.5 * r["n"]
        mass[i + 1] = own
        mass[_SINGLES + (r["top_codes"] >> 14) % _SHARED] -= own
    return int(total), int(distinct), np.array([r["top_codes"] for r in top], np.int64), mass


def coded(codes: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """Feature bits and group of each code: hash in the low 14 bits, group above."""
    group = _SINGLES + (codes.astype(np.int64) >> 14) % _SHARED
    if len(singles):
        order = np.argsort(singles)
        at = np.minimum(np.searchsorted(singles[order], codes), len(singles) - 1)
        group = np.where(singles[order][at] == codes, order[at] + 1, group)
    group[codes == 0] = 0
    return ((codes.astype(np.int64) & 0x3FFF) | group << 14).astype(np.int32)


def _documents(batch: pa.RecordBatch, i: int, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of a chunk's documents one after another, their sizes, and which are held out."""
    sizes = np.asarray(batch.column("sizes")[i].values)
    ids = unpacked(batch.column("ids")[i].as_py(), int(sizes.sum()))
    table = coded(unpacked(batch.column("codes")[i].as_py(), int(ids.max()) + 1), singles)
    return table[ids], sizes, np.array(batch.column("held_out")[i].as_py(), bool)


def fit_and_encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out_fold: int = 1) -> tuple[DataFrame, Model, np.ndarray, int, int]:
    """Encoded chunks, the trained model, the codes of single-token groups, and the numbers of training tokens and of distinct ones."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", (fold() == held_out_fold).alias("held_out"), "text")
    both = settled(numbered(rows))
    of_token = Window.partitionBy("token")
    place = F.shiftleft("chunk", 24).bitwiseOR(F.col("local").cast("long"))  # few wide columns keep the shuffles small
    words = both.where("token IS NOT NULL").select(place.alias("place"), "token", F.col("n").cast("int").alias("n"))
    suffix = F.crc32(F.expr(f"substring(token, -{SUFFIX}, {SUFFIX})"))
    code = suffix.bitwiseAND(F.lit(0xFFFFC000)).bitwiseOR(F.crc32("token").bitwiseAND(F.lit(0x3FFF)))  # group above, feature below
    first = (F.row_number().over(of_token.orderBy("place")) == 1).cast("long")
    low = F.shiftleft(F.col("place").bitwiseAND(F.lit((1 << 24) - 1)), 33).bitwiseOR(F.shiftleft(first, 32)).bitwiseOR(code)
    words = words.select(F.shiftright("place", 24).alias("chunk"), F.sum("n").over(of_token).alias("c"), low.alias("packed"))
    chunks = both.where("ids IS NOT NULL").select(F.col("chunk").alias("chunk"), "doc_ids", "held_out", "sizes", "ids")
    encoded = settled(chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_encoded, _ENCODED_SCHEMA))
    total, distinct, singles, mass = _masses(encoded)

    model = Model(mass)
    for turn in range(ROUNDS if total else 0):
        sent = spark.sparkContext.broadcast((model, singles))  # fixed size, about 5 MB
        changes = encoded.select("held_out", "sizes", "ids", "codes").mapInArrow(_train(sent, turn, RATE / (1 + turn)), _PART_SCHEMA)
        model.class_weights, model.group_weights = _averaged(changes, model)
        sent.unpersist()
    return encoded, model, singles, total, distinct


def _train(sent, turn: int, rate: float):
    """Rows of a task's weights, each table in _PARTS pieces: cut here, as a second Python step would double the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, singles = sent.value
        own = Model(shared.mass)
        own.class_weights, own.group_weights = shared.class_weights.copy(), shared.group_weights.copy()
        seen = 0
        for batch in batches:
            for i in range(batch.num_rows):
                codes, sizes, held_out = _documents(batch, i, singles)
                use = ~held_out & (np.arange(len(sizes)) % ROUNDS == turn)
                codes, sizes = codes[np.repeat(use, sizes)], sizes[use]
                if not len(codes):
                    continue
                for step_codes, hashed in own.steps(codes, sizes):
                    own.step(step_codes, hashed, rate)
                seen += len(codes)
            give_back()
        if seen:
            tables = [own.class_weights.astype(np.float16).tobytes(), own.group_weights.astype(np.float16).tobytes()]
            pieces = [x[k * len(x) // _PARTS : (k + 1) * len(x) // _PARTS] for x in tables for k in range(_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * _PARTS), pa.int32()), pa.array([float(seen)] * 2 * _PARTS), pa.array(pieces, pa.binary())], names=["part", "tokens", "weights"])

    return run


def _averaged(changes: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token-weighted averages of the tasks' weights, added up by table part in a shuffle."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                mine = sums.setdefault(part, [0.0, 0.0])
                mine[0] += n
                mine[1] = mine[1] + n * np.frombuffer(w.as_buffer(), np.float16).astype(np.float64)
        for part, (n, w) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([(w / n).astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "weights"])

    rows = changes.repartition(2 * _PARTS, "part").mapInArrow(add, _PART_SCHEMA).collect()  # a fixed size
    by_part = {r["part"]: np.frombuffer(r["weights"], np.float32) for r in rows}
    if not by_part:
        return model.class_weights, model.group_weights
    return np.concatenate([by_part[k] for k in range(_PARTS)]).reshape(CLASS_BUCKETS, CLASSES), np.concatenate([by_part[_PARTS + k] for k in range(_PARTS)]).reshape(-1, GROUPS)


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out_fold: int = 1) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    encoded, model, singles, total, distinct = fit_and_encode(docs, id_column, text_column, held_out_fold)
    sent = docs.sparkSession.sparkContext.broadcast((model, singles))
    norm = math.log10(total + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, singles = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                codes, sizes, _ = _documents(batch, i, singles)
                starts = np.cumsum(sizes) - sizes
                place = np.concatenate([model.score(*step) for step in model.steps(codes, sizes)])
                log_sum = np.asarray(batch.column("log_sum")[i].values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, batch.column("held_out")[i].values, pa.array(sizes, pa.int64()), batch.column("known")[i].values, pa.array(log_sum), pa.array(np.add.reduceat(place, starts) + log_sum)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "log_sum", "score"],
                )
            give_back()

    found = encoded.select("doc_ids", "held_out", "sizes", "ids", "codes", "known", "log_sum").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("log_sum") - F.col("n_tokens") * norm).alias("base_score"), "score")
