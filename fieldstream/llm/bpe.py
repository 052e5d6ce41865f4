"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of byte strings form a monoid under "join": the encoding of two
neighbours comes from their own encodings by encoding anew a window around the
boundary and widening it until the tokens outside provably stay. The proof is
local: a token sequence is the encoding of its bytes if and only if each pair of
adjacent tokens is the encoding of that pair's bytes, so once the pairs at both
edges of the window hold, everything outside is settled. A piece is therefore
encoded as a tree of joins over short leaves, and decoding concatenates bytes up
a tree over runs of ids.

A window doubles where its edge does not hold, so a join costs no more than a
few encodings of what it changes. Long windows only arise in periodic bytes (a
run of one letter has no place where encodings meet); they are encoded by
merging all places of the least rank at once, or by a heap where a merge makes a
pair of lower rank. Long pieces are cut at powers of two, where such runs meet, and
short ones in halves, which are often known already.

Each match of the split pattern is a piece of its own. Pieces, windows and pairs
of at most SHORT bytes are remembered per Python worker, up to a fixed number of
entries.

Defined results: a null text counts as empty; an empty text has no tokens, and
the digests are those of the empty string. Bytes that are no UTF-8 become the
replacement character. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Bytes of a leaf of the encoding tree, and ids of a leaf of the decoding tree.
LEAF, DECODED_LEAF = 5, 4096
#: Longest bytes that are remembered and merged by plain search.
SHORT = 64
#: Entries of a worker's memory of pieces, and of those of windows and pairs; they start anew when full.
PIECES, MEMORY = 250_000, 100_000
#: A vocabulary file larger than this is not sent to executors.
MAX_VOCABULARY_BYTES = 64 << 20

_NEVER = 1 << 60

DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Pieces(dict):
    """Encodings of pieces by text, made when first asked for."""

    def __init__(self, encode: Callable[[bytes], tuple[int, ...]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder for a rank file (base64 token, blank, rank; a line each) and a split pattern."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.text_of = {rank: str(rank) for rank in self.tokens}
        self.bytes_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.pieces = _Pieces(self.encode_bytes)
        self.small: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """Plain BPE: merge the leftmost adjacent pair of least rank until none is left."""
        if len(data) > SHORT:
            return self._merged_at_once(data) or self._merged_by_heap(data)
        found = self.small.get(data)
        if found is None:
            ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best, at = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(self.small) >= MEMORY:
                self.small.clear()
            found = self.small[data] = tuple(ranks[p] for p in parts)
        return found

    def _merged_at_once(self, data: bytes) -> tuple[int, ...] | None:
        """The same for bytes of few distinct pairs, all places of one rank a round; None where this might differ."""
        ids = self.bytes_ids[np.frombuffer(data, np.uint8)]
        last = -1
        while len(ids) > 1:
            pairs, which = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
            if len(pairs) > 32 + len(ids) // 8:
                return None
            rank = np.array([self.ranks.get(self.tokens[p >> 32] + self.tokens[p & 0xFFFFFFFF], _NEVER) for p in pairs.tolist()], np.int64)
            best = int(rank.min())
            if best < last:  # made by the merge before, at whose other places it should have come first
                return None
            if best == _NEVER:
                break
            hit = np.flatnonzero(rank[which] == best)
            run = np.cumsum(np.concatenate([[True], np.diff(hit) > 1])) - 1  # of places that overlap, every other one from the left
            first = hit[np.searchsorted(run, run)]
            at = hit[(hit - first) % 2 == 0]
            beside = np.unique(ids[at[:-1][np.diff(at) == 2] + 2]).tolist()  # what stands right of a merged place until its own turn
            if any(self.ranks.get(self.tokens[best] + self.tokens[b], _NEVER) < best for b in beside):
                return None
            ids[at] = best
            ids = np.delete(ids, at + 1)
            last = best
        return tuple(ids.tolist())

    def _merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        """The same for any bytes, with a heap of pairs and links to what stands beside."""
        ranks, n = self.ranks, len(data)
        part: list[bytes] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:  # one of them has been merged since
                continue
            part[i], part[j] = part[i] + part[j], b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heappush(heap, (r, i, size + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heappush(heap, (r, h, len(part[h]) + size))
        return tuple(ranks[p] for p in part if p)

    def _stays(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a, b are encoded as a, b."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merged(self.tokens[a] + self.tokens[b]) == (a, b)
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours, neither of them empty, from their encodings."""
        if (stays := self.pairs.get((left[-1], right[0]))) or (stays is None and self._stays(left[-1], right[0])):
            return left + right
        a, b = 1, 1
        while True:
            window = self._merged(self._bytes(left[-a:]) + self._bytes(right[:b]))
            left_holds = a >= len(left) or self._stays(left[-a - 1], window[0])
            right_holds = b >= len(right) or self._stays(window[-1], right[b])
            if left_holds and right_holds:
                return left[:-a] + window + right[b:]
            a, b = a if left_holds else min(len(left), 2 * a), b if right_holds else min(len(right), 2 * b)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one piece, as a tree of joins."""
        if len(data) <= LEAF:
            return self.small.get(data) or self._merged(data)
        cut = len(data) // 2 if len(data) <= SHORT else SHORT << ((len(data) - 1) // SHORT).bit_length() - 1
        return self.join(self.encode_bytes(data[:cut]), self.encode_bytes(data[cut:]))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; each match of the pattern is encoded separately."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def _bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> bytes:
        """The bytes of ids, concatenated up a tree over runs of them."""
        level = [self._bytes(ids[i : i + DECODED_LEAF]) for i in range(0, len(ids), DECODED_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_ready: dict[int, Bpe] = {}


def _coder(key: int, ranks_file: bytes, pattern: str) -> Bpe:
    """One coder a worker, so that its memory serves all its tasks."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Bpe(ranks_file, pattern)
    return _ready[key]


def _shared(docs: DataFrame, vocabulary: str, pattern: str) -> Callable[[], Bpe]:
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    key = hash((data, pattern))
    return lambda: _coder(key, sent.value, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, ids) for each document; no shuffle."""
    coder = _shared(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder()
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                ids = [bpe.encode((t or b"").decode(errors="replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data) with the decoded bytes of rows (doc_id, ids); null ids count as none."""
    coder = _shared(encoded, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder()
        for batch in batches:
            data = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass (DIGEST_SCHEMA), so that ids never leave the task."""
    coder = _shared(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder()
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                n, ids_hash, data_hash = [], [], []
                for t in texts:
                    ids = bpe.encode((t or b"").decode(errors="replace"))
                    n.append(len(ids))
                    ids_hash.append(sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    data_hash.append(sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(data_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, DIGEST_SCHEMA)
