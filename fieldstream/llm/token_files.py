"""Token-id files with keyed access by a minimal perfect hash index.

Writing: texts are dealt by ranges of (id, text) and sorted, so that a write task, a
shard, holds consecutive documents. Each text is encoded by the tokenizers library;
the strings of special tokens are ordinary text, and an end id follows. Texts are cut
where a vocabulary of byte-level BPE with that library's usual pattern ends a piece for
certain, before a blank and a character, and ids of parts that a worker has met are
remembered, so that the library encodes most of them once a worker.

A file is a run of blocks (HEADER; then ids, presence flags and token counts of its
documents; then the raw ids, 2 or 4 bytes each, little endian). Spark's text writer puts
blocks into files of about FILE_BLOCKS of them in the shared folder and commits whole
tasks, so a lost executor's task is simply written again.

Indexing: documents are found in the files by (doc_id, nth), nth counting those of equal
id. Keys are dealt by hash to parts of about PART_KEYS; each part is a minimal perfect
hash: at each level, keys that have a place of a bit array for themselves stay there, the
others go on to the next, smaller one; a key's slot is the number of bits set before its
own. Keys left after LEVELS levels are listed and searched. A slot stores a fingerprint,
the shard, the offset in it and the number of ids, so access is a few array reads,
whatever the number of keys; unknown keys fail at their fingerprint, but for one in
2^32, which the key beside the payload refutes.

Only one number of ids and of copies a shard goes through the driver, less than Spark
keeps there of the task that wrote it.

Defined results: a null or empty text has the end id only; documents without id come
first, are read back, but have no key; repeated ids are each kept, ordered by a hash of
their texts, as (doc_id, 0), (doc_id, 1), ...; bytes that are no UTF-8 become the
replacement character; a piece without any blank, of any length, is encoded as one; an
empty table writes no documents; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, settled

#: Bytes of ids of a block, and blocks of a file; a longer document is a block of its own.
BLOCK_BYTES, FILE_BLOCKS = 4 << 20, 8
#: Keys of a part of the index, levels of its hash, and bits a key at each level.
PART_KEYS, LEVELS, SPARSE = 1 << 14, 24, 2
#: Parts of texts that a worker remembers; longer ones it does not.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 48
#: Bytes of a vocabulary file, which goes to all tasks.
MAX_VOCABULARY_BYTES = 64 << 20
#: Files that `fetch` names one by one; for keys in more of them it reads the whole folder.
FEW_FILES = 1_000

MAGIC = b"IDBLOCK1"
#: Width of an id, documents, ids, shard, ids and documents before it in the shard, documents before it with its first document's id.
HEADER = struct.Struct("<8sIIQQQQQ")
SCAN_SCHEMA = "file string, shard long, doc_no long, offset long, n_tokens long, doc_id long, nth long, ids_crc32 long, ids binary"
#: Before a blank that has a character behind it which no library counts as white space.
_CUT = re.compile(r"(?= [^\s\u180e\u200b\ufeff])")
#: What makes a text no plain one: other blanks, and a comma or full stop behind neither letter nor digit.
_BLANKS, _PUNCTUATION = re.compile(r" [\s\u180e\u200b\ufeff]"), re.compile(r"[,.](?<![^\W_].)")


# ---- encoding -------------------------------------------------------------------------


def parts_of(text: str) -> list[str]:
    """The text cut where the vocabulary's pattern ends a piece for certain: before a blank with a character behind it and, in plain texts, before a comma or full stop behind a letter or digit."""
    if _PUNCTUATION.search(text) or _BLANKS.search(text) or "\0" in text or text.endswith(" "):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").split("\0")


class Encoder:
    """Ids of texts as bytes, by the tokenizers library and a memory of parts of texts."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {"": b""}

    def _encoded(self, parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        found = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        ids, sizes = np.array(found.ids, f"<u{self.width}").tobytes(), np.bincount(found.word_ids, minlength=len(parts))
        ends = (self.width * np.cumsum(sizes)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new parts of a run of texts are encoded together."""
        parts = [parts_of(t) for t in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)  # a difference from its keys would walk all that is known
        kept = [p for p in new if len(p) <= REMEMBERED_CHARS]
        if len(self.known) + len(kept) > REMEMBERED:
            self.known = {"": b""}
            kept = [p for p in set(chain.from_iterable(parts)) if 0 < len(p) <= REMEMBERED_CHARS]
        self.known.update(zip(kept, self._encoded(kept), strict=True))
        if len(kept) == len(new):
            return [b"".join(map(self.known.__getitem__, p)) for p in parts]
        long = [p for p in new if len(p) > REMEMBERED_CHARS]
        all_known = ChainMap(self.known, dict(zip(long, self._encoded(long), strict=True)))
        return [b"".join(map(all_known.__getitem__, p)) for p in parts]


_ready: dict[int, Encoder] = {}


def _encoder(key: int, vocabulary: str) -> Encoder:
    """One encoder a worker, so that its memory serves all its tasks."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(vocabulary)
    return _ready[key]


# ---- files ------------------------------------------------------------------------------


class _Block:
    """Documents of the block that a task is filling, and what came before it in the shard."""

    def __init__(self, width: int, shard: int, full: int) -> None:
        self.width, self.shard, self.full, self.ids, self.docs, self.run = width, shard, full, 0, 0, 0
        self.last: tuple | None = None
        self._start()

    def _start(self) -> None:
        self.keys, self.sizes, self.data, self.bytes = [], [], [], 0
        self.first_run = 0

    def add(self, key: int | None, data: bytes) -> None:
        self.run = self.run + 1 if self.last == (key,) else 0
        if not self.keys:
            self.first_run = self.run
        self.last = (key,)
        self.keys.append(key)
        self.sizes.append(len(data) // self.width)
        self.data.append(data)
        self.bytes += len(data)

    def taken(self) -> list[bytes]:
        """The block, and an empty row for each further `full` bytes, as files are cut by rows."""
        n, n_ids = len(self.keys), self.bytes // self.width
        head = HEADER.pack(MAGIC, self.width, n, n_ids, self.shard, self.ids, self.docs, self.first_run)
        keys = array("q", [k or 0 for k in self.keys]).tobytes() + bytes(k is not None for k in self.keys) + array("q", self.sizes).tobytes()
        rows = [b"".join((head, keys, *self.data)), *[b""] * (self.bytes // self.full - 1)]
        self.ids, self.docs = self.ids + n_ids, self.docs + n
        self._start()
        return rows


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """Write the ids of each text and the end id to files below path, in ascending order of the documents' ids."""
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    sent, key = docs.sparkSession.sparkContext.broadcast(data), hash(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, sent.value)
        end = array(encoder.code, [end_id]).tobytes()
        block = _Block(encoder.width, TaskContext.get().partitionId(), block_bytes)
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode([(t or b"").decode(errors="replace") for t in texts]), strict=True):
                    block.add(doc_id, ids + end)
                    if block.bytes >= block_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(block.taken(), pa.binary())], names=["value"])
        if block.keys:
            yield pa.RecordBatch.from_arrays([pa.array(block.taken(), pa.binary())], names=["value"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # equal rows have a number of their own, so that many of them do not meet in one shard
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("salt"))
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ranged.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    blocks.write.option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def documents_of(data: memoryview, with_ids: bool) -> Iterator[tuple]:
    """Rows of SCAN_SCHEMA, without the file, of the blocks of a file."""
    at = 0
    while at < len(data):
        if data[at] == 0x0A:  # the writer's line end
            at += 1
            continue
        magic, width, n, n_ids, shard, offset, doc_no, nth = HEADER.unpack_from(data, at)
        keys_at = at + HEADER.size
        ids_at = keys_at + 17 * n
        if magic != MAGIC or ids_at + n_ids * width > len(data):
            raise ValueError(f"no block at byte {at}")
        keys = np.frombuffer(data, "<i8", n, keys_at).tolist()
        there = data[keys_at + 8 * n : keys_at + 9 * n].tolist()
        sizes = np.frombuffer(data, "<i8", n, keys_at + 9 * n).tolist()
        ids = np.frombuffer(data, f"<u{width}", n_ids, ids_at)
        start, last = 0, None
        for key, known, size in zip(keys, there, sizes, strict=True):
            key = key if known else None
            nth = nth if last is None else nth + 1 if last == (key,) else 0
            last = (key,)
            own = ids[start : start + size].astype("<u4").tobytes()
            yield shard, doc_no, offset + start, size, key, nth, crc32(own), own if with_ids else None
            start, doc_no = start + size, doc_no + 1
        at = ids_at + n_ids * width


def scan(spark: SparkSession, paths: str | list[str], with_ids: bool = False) -> DataFrame:
    """Every document in the files (SCAN_SCHEMA): its place, its token count, its key as far as its shard tells, the crc32 of its ids and, where asked for, the ids as unsigned 32-bit integers."""
    names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
    types = [pa.string(), *[pa.int64()] * 7, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for row in documents_of(memoryview(content.as_buffer()), with_ids):
                    rows.append((file, *row))
                    size += len(row[-1] or b"")
                    if len(rows) >= 10_000 or size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SCAN_SCHEMA)


# ---- minimal perfect hash --------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 scrambled bits for each integer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(ids: np.ndarray, nth: np.ndarray, level: int) -> np.ndarray:
    step = 0x9E3779B97F4A7C15
    return _mixed(_mixed(ids.astype(np.uint64) + np.uint64(step * (2 * level + 1) % (1 << 64))) ^ (nth.astype(np.uint64) * np.uint64(step) + np.uint64(level)))


class PerfectHash:
    """A minimal perfect hash of keys (id, nth): bit arrays by level, ranks by 64-bit word, and the keys left over."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray) -> None:
        self.levels, self.left = levels, left
        counts = [np.bitwise_count(words).astype(np.int64) for words in levels]
        self.ranks = [np.cumsum(c) - c for c in counts]
        self.before = np.cumsum([0, *[int(c.sum()) for c in counts]]).tolist()

    @classmethod
    def of(cls, ids: np.ndarray, nth: np.ndarray) -> PerfectHash:
        levels = []
        while len(ids) and len(levels) < LEVELS:
            size = -(-SPARSE * len(ids) // 64) * 64
            place = _hashed(ids, nth, len(levels)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size)[place.astype(np.int64)] == 1
            bits = np.zeros(size, np.uint8)
            bits[place[alone].astype(np.int64)] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            ids, nth = ids[~alone], nth[~alone]
        return cls(levels, np.array(sorted(zip(ids.tolist(), nth.tolist(), strict=True)), np.int64).reshape(-1, 2))

    def slots(self, ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not put in, any slot or -1."""
        out, open_ = np.full(len(ids), -1, np.int64), np.arange(len(ids))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = _hashed(ids[open_], nth[open_], level) % np.uint64(64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.before[level] + ranks[word[hit]] + below[hit]
            open_ = open_[~hit]
        if len(self.left):
            at = {tuple(k): i for i, k in enumerate(self.left.tolist())}
            out[open_] = [self.before[-1] + at[k] if (k := (int(ids[i]), int(nth[i]))) in at else -1 for i in open_]
        return out

    def to_bytes(self) -> bytes:
        return b"".join((struct.pack("<II", len(self.levels), len(self.left)), *[struct.pack("<I", len(w)) for w in self.levels], *[w.tobytes() for w in self.levels], self.left.astype("<i8").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n, n_left = struct.unpack_from("<II", data)
        sizes, at, levels = struct.unpack_from(f"<{n}I", data, 8), 8 + 4 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(levels, np.frombuffer(data, "<i8", 2 * n_left, at).reshape(-1, 2))


def _fingerprints(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return (_hashed(ids, nth, 1_000) >> np.uint64(32)).astype("<u4")


# ---- index ---------------------------------------------------------------------------------------

_PART_SCHEMA = "part long, hash binary, fingerprints binary, shards binary, offsets binary, sizes binary"
FOUND_SCHEMA = "doc_id long, nth long, shard long, offset long, start long, n_tokens long"


def _part(n_parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(n_parts))


def build_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Write the index of the files below path to the folder index; returns the documents of the files with their start and nth among all shards."""
    seen = settled(scan(spark, path).drop("ids"))
    first_run = F.col("nth") == F.col("doc_no")
    facts = seen.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"), F.min_by(F.struct("doc_id"), "doc_no").alias("first"), F.max_by(F.struct("doc_id"), "doc_no").alias("last"), F.count_if(first_run).alias("head"), F.max_by("nth", "doc_no").alias("nth"))
    bases, start, last, run, n_docs = [], 0, None, 0, 0
    for s in sorted(facts.collect()):
        goes_on = last is not None and last == s["first"]
        bases.append((s["shard"], start, run if goes_on else 0))
        run = (run if goes_on and s["head"] == s["n_docs"] else 0) + s["nth"] + 1
        start, last, n_docs = start + s["n_ids"], s["last"], n_docs + s["n_docs"]
    base = spark.createDataFrame(bases, "shard long, base long, run long")
    docs = seen.join(base, "shard").withColumns({"start": F.col("base") + F.col("offset"), "nth": F.col("nth") + F.when(first_run, F.col("run")).otherwise(0)}).drop("base", "run")

    n_parts = max(1, -(-n_docs // PART_KEYS))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids, nth, shards, offsets, sizes = (rows.column(c).to_numpy() for c in ("doc_id", "nth", "shard", "offset", "n_tokens"))
        found = PerfectHash.of(ids, nth)
        slots = found.slots(ids, nth)
        put = lambda values, kind: values[np.argsort(slots)].astype(kind).tobytes()
        row = [key[0].as_py(), found.to_bytes(), put(_fingerprints(ids, nth), "<u4"), put(shards, "<u4"), put(offsets, "<u8"), put(sizes, "<u8")]
        return pa.table([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], names=[c.split()[0] for c in _PART_SCHEMA.split(", ")])

    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "nth", "shard", "offset", "n_tokens", _part(n_parts).alias("part"))
    parts = keyed.groupBy("part").applyInArrow(build, _PART_SCHEMA)
    parts.withColumn("n_parts", F.lit(n_parts).cast("long")).write.parquet(f"{index}/parts")
    base.write.parquet(f"{index}/shards")
    seen.groupBy("file", "shard").agg(F.min("offset").alias("offset_from"), F.max("offset").alias("offset_to")).write.parquet(f"{index}/files")
    return docs


def lookup(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """The place (FOUND_SCHEMA) of each distinct key (doc_id, nth) that the index has; other keys give no row, but for one in 2^32 of them."""
    table = spark.read.parquet(f"{index}/parts")
    one = table.select("n_parts").first()
    wanted = keys.where("doc_id IS NOT NULL").select("doc_id", F.col("nth").cast("long").alias("nth")).distinct().withColumn("part", _part(one[0] if one else 1))

    def find(wanted: pa.Table, parts: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 5
        if parts.num_rows and wanted.num_rows:
            part = parts.to_pylist()[0]
            ids, nth = wanted.column("doc_id").to_numpy(), wanted.column("nth").to_numpy()
            slots = PerfectHash.from_bytes(part["hash"]).slots(ids, nth)
            there = (slots >= 0) & (np.frombuffer(part["fingerprints"], "<u4")[slots] == _fingerprints(ids, nth))
            slots = slots[there]
            out = [ids[there], nth[there], *(np.frombuffer(part[c], kind)[slots].astype(np.int64) for c, kind in (("shards", "<u4"), ("offsets", "<u8"), ("sizes", "<u8")))]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["doc_id", "nth", "shard", "offset", "n_tokens"])

    found = wanted.groupBy("part").cogroup(table.drop("n_parts").groupBy("part")).applyInArrow(find, "doc_id long, nth long, shard long, offset long, n_tokens long")
    return found.join(spark.read.parquet(f"{index}/shards"), "shard").select("doc_id", "nth", "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n_tokens")


def fetch(spark: SparkSession, path: str, index: str, keys: DataFrame, with_ids: bool = True) -> DataFrame:
    """Ids of the documents with the keys (doc_id, nth): FOUND_SCHEMA, ids_crc32 and ids. Only files that hold one of them are read, unless they are many."""
    found = lookup(spark, index, keys)
    files = spark.read.parquet(f"{index}/files")
    inside = (found["shard"] == files["shard"]) & (found["offset"] >= files["offset_from"]) & (found["offset"] <= files["offset_to"])
    some = [r["file"] for r in found.join(files, inside).select("file").distinct().limit(FEW_FILES + 1).collect()] if with_ids else []
    rows = scan(spark, some if 0 < len(some) <= FEW_FILES else path, with_ids)
    payload = rows.select("shard", "offset", F.col("n_tokens").alias("n_there"), F.col("doc_id").alias("key_there"), "ids_crc32", "ids")
    same = (F.col("n_there") == F.col("n_tokens")) & (F.col("key_there") == F.col("doc_id"))
    return found.join(payload, ["shard", "offset"]).where(same).drop("n_there", "key_there")


def round_trip(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the files, index them, and read every document back by its key: doc_id, start, n_tokens and ids_crc32. Documents without id are read by their place."""
    spark = docs.sparkSession
    write(docs, f"{path}/ids", vocabulary, end_id, id_column, text_column, block_bytes)
    there = build_index(spark, f"{path}/ids", f"{path}/index")
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    by_key = fetch(spark, f"{path}/ids", f"{path}/index", there.select("doc_id", "nth"), with_ids=False)
    return by_key.select(*columns).unionByName(there.where("doc_id IS NULL").select(*columns))
