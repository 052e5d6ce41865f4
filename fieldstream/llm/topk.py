"""Exact top-k search by integer inner product with block-at-a-time pruning.

Rows are dealt by hash into slabs of bounded size, a slab to a task. In a slab
the rows stand in an order that puts similar vectors together and are cut into
document-range blocks, each with the largest and smallest value of every term
(vector component). For each query the blocks are ordered by their summed term
maxima, and scored through their forward index (the block's matrix) until the
next bound is below the query's k-th score so far. Pruned blocks cannot hold a
result, so the result is exact; slabs are merged by a window per query.

Queries are sent to the slabs in chunks of bounded size, one chunk after another:
more queries mean more passes, each of which writes its results and frees its
broadcast, not a larger plan or broadcast. `pruned` tells how much is scored.

Defined results: a vector that is null or holds a null or non-finite component,
and a row without id, takes no part; shorter vectors count as padded with
zeros; a query never returns rows of its own id; equal rows of other ids are
results of their own; equal query rows are one query; ties go to the smaller
id; an empty table gives no rows. Sums are exact as 64-bit integers;
vectors so large that a sum or bound might not fit these are an error, never a wrapped sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Rows of a slab and of a block.
SLAB_ROWS, BLOCK_ROWS = 16_384, 256
#: Bytes of query vectors sent at once.
QUERY_BYTES = 16 << 20
#: Beyond this, a sum or the bound of a block might not fit 64 bits.
MAX_SUM = float(1 << 63)

RESULT_SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """Rows (vec_id, terms array<long>) of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("terms"))


def _matrix(terms: pa.Array, width: int) -> np.ndarray:
    """Rows of terms as one matrix, padded with zeros."""
    n = np.asarray(terms.value_lengths())
    flat = np.asarray(terms.flatten(), np.int64)
    out = np.zeros((len(terms), width), np.int64)
    out[np.repeat(np.arange(len(terms)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _order(m: np.ndarray) -> np.ndarray:
    """An order of rows in which those with the same nearest pivot stand together."""
    pivots = m[:: max(1, len(m) // 64)].astype(np.float32)
    return np.argsort(np.argmax(m.astype(np.float32) @ pivots.T, axis=1), kind="stable")


def search_slab(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of a slab for each query, as (query position, row id, score), and the number of scored (query, block) pairs."""
    top = max(abs(int(queries.min(initial=0))), int(queries.max(initial=0))) * max(abs(int(rows.min(initial=0))), int(rows.max(initial=0)))
    kind = np.float64 if top * max(1, rows.shape[1]) < 1 << 53 else np.int64  # both exact; floats are faster
    order = _order(rows)
    q, rows, row_ids = queries.astype(kind), rows[order].astype(kind), row_ids[order]
    starts = np.arange(0, len(rows), BLOCK_ROWS)
    bounds = np.maximum(q, 0) @ np.maximum.reduceat(rows, starts).T + np.minimum(q, 0) @ np.minimum.reduceat(rows, starts).T
    best_first = np.argsort(-bounds, axis=1, kind="stable")
    at, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    kth, open_, scored = np.full(len(q), least, kind), np.arange(len(q)), 0
    for turn in range(len(starts)):
        block = best_first[open_, turn]
        alive = bounds[open_, block] >= kth[open_]
        open_, block = open_[alive], block[alive]
        if not len(open_):
            break
        scored += len(open_)
        found = [(at, ids, scores)]
        by_block = np.argsort(block, kind="stable")
        for group in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            b, who = starts[block[group[0]]], open_[group]
            own = row_ids[b : b + BLOCK_ROWS]
            s = q[who] @ rows[b : b + BLOCK_ROWS].T
            x, y = np.nonzero((s >= kth[who][:, None]) & (own[None, :] != query_ids[who][:, None]))
            found.append((who[x], own[y], s[x, y]))
        at, ids, scores = map(np.concatenate, zip(*found, strict=True))
        keep = np.lexsort((ids, -scores, at))
        at, ids, scores = at[keep], ids[keep], scores[keep]
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(at)))
        rank = np.arange(len(at)) - np.repeat(begin, size)
        full = begin[size >= k]
        kth[at[full]] = scores[full + k - 1]
        at, ids, scores = at[rank < k], ids[rank < k], scores[rank < k]
    return at, ids, scores.astype(np.int64), scored


def _slab_search(sent, width: int, k: int, count: bool = False):
    """The function that searches one slab, a table of vec_id and terms, for a broadcast chunk of queries, or counts its (query, block) pairs and those that are scored."""

    def run(slab):
        pairs = scored = 0
        query_ids, q = sent.value
        rows, row_ids = _matrix(slab.column("terms").combine_chunks(), width), np.asarray(slab.column("vec_id"), np.int64)
        out = [pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})]
        for i in range(0, len(q), 1024):
            at, ids, scores, n = search_slab(q[i : i + 1024], query_ids[i : i + 1024], rows, row_ids, k)
            pairs, scored = pairs + len(q[i : i + 1024]) * -(-len(rows) // BLOCK_ROWS), scored + n
            out.append(pa.table({"query_id": query_ids[i + at], "vec_id": ids, "score": scores}))
        return pa.table({"pairs": [pairs], "scored": [scored]}) if count else pa.concat_tables(out)

    return run


def _passes(vectors: DataFrame, is_query: Column, k: int, id_column: str, vector_column: str, scale: int, query_bytes: int, count: bool) -> DataFrame:
    """The results of all slabs for all chunks of queries, as rows of RESULT_SCHEMA or counts."""
    spark = vectors.sparkSession
    rows = settled(integer_vectors(vectors, id_column, vector_column, scale))
    largest = F.max(F.array_max(F.transform("terms", lambda x: F.abs(x.cast("double")))))  # as doubles, since floors beyond a long stop at its ends
    total, width, n_queries, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("terms")), F.lit(0)), F.count_if(is_query), F.coalesce(largest, F.lit(0.0))).first()
    slabs, width = max(1, -(-total // SLAB_ROWS)), max(1, width)
    if largest * largest * width >= MAX_SUM:
        raise ValueError(f"sums of {width} products of terms up to {largest:.0f} may not fit a long")
    chunks = max(1, -(-n_queries * width * 8 // query_bytes))
    dealt = rows.withColumn("slab", F.pmod(F.xxhash64("vec_id", "terms"), F.lit(slabs)))
    queries = rows.where(is_query).dropDuplicates()
    if chunks > 1:
        queries = settled(queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))))
    found = None
    for chunk in range(chunks):
        some = (queries.where(F.col("chunk") == chunk) if chunks > 1 else queries).toArrow()  # about query_bytes
        sent = spark.sparkContext.broadcast((np.asarray(some.column("vec_id"), np.int64), _matrix(some.column("terms").combine_chunks(), width)))
        part = dealt.groupBy("slab").applyInArrow(_slab_search(sent, width, k, count), "pairs long, scored long" if count else RESULT_SCHEMA)
        if chunks > 1:
            best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            part = settled(part if count else part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
            sent.destroy()
        found = part if found is None else found.unionAll(part)
    return found


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows for each row for which is_query (a condition on vec_id) holds."""
    found = _passes(vectors, is_query, k, id_column, vector_column, scale, query_bytes, False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruned(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One row (pairs, scored): the (query, block) pairs there are, and those whose bound asked for their scores."""
    found = _passes(vectors, is_query, k, id_column, vector_column, scale, query_bytes, True)
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
