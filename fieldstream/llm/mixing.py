"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's size is its number of words. Sources in code-point order (null last)
weigh 1, 2, 3, repeating, and share the whole size; a target stops at
`max_repeats` times its source's size and the excess goes to the others by
weight. A hash of the document permutes each source; equal ranges of the hash
are the source's blocks, more of them for a larger source. A source is taken whole
as often as its target allows, then block by block up to the document at which the
target is reached.

The draws of all sources are dealt to output shards of equal numbers of blocks:
a tree halves the shards and, at each node, a multivariate hypergeometric draw
gives one half its exact quota of each source's blocks. A leaf's quota becomes a
run of the source's permuted blocks, disjoint from those of other shards, and
the shard is shuffled locally. A document's copies are the draws of its block; only
the last draw of a source ends within its block, at the cut.

Counts per (source, block) are shuffled, and the narrow rows of the one block of
each source in which its target is reached; there a hash value, the cut, is found.
A few numbers a source go through the driver and to all tasks; their number is
checked. Tasks draw the leaves, so shards are as many as the size asks for; documents
meet the table of drawn blocks, which is sent to them while it is small and else
joined by source and block.

Defined results: a null text has size 0; such documents follow their block; an
empty table gives no rows; equal rows are separate documents, which of them is
taken once more is arbitrary and makes no difference; rows that share an id are
permuted by their texts; document columns of any name pass through `mix` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled

#: Blocks of a source at least, as a power of two, and words of a block of a larger source.
LEAST_BITS, BLOCK_WORDS = 10, 1_000_000
#: Sources at most, some hundred bytes each on the driver, and draws of blocks (a limit of the hypergeometric sampler).
MAX_SOURCES, MAX_DRAWS = 100_000, 1_000_000_000
#: Words of an output shard, and the fewest shards.
SHARD_WORDS, LEAST_SHARDS = 10_000_000, 16
#: Draws whose table is sent to all tasks, about 100 bytes each (more are joined by a shuffle), and draws that a task of the tree walks to.
SENT_DRAWS, PART_DRAWS = 1 << 18, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 53


def targets(sizes: list[int], weights: list[int], max_repeats: int = 3) -> list[float]:
    """Shares of the whole by weight, none above max_repeats times its size, the excess reshared by weight."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    cap, out, open_ = max_repeats * size, np.zeros(len(size)), np.ones(len(size), bool)
    while open_.any():
        level = (size.sum() - out[~open_].sum()) / weight[open_].sum()
        over = open_ & (level * weight >= cap)
        if not over.any():
            out[open_] = level * weight[open_]
            break
        out[over] = cap[over]
        open_ &= ~over
    return out.tolist()


def runs(quotas: np.ndarray, shards: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The leaves of the tree from shard low to before high: (shard, sources, first draw of each, number of its draws).

    A node halves its shards; a multivariate hypergeometric draw, fixed by seed and node,
    gives the left half its quota of each source. Whoever needs some leaves walks to them
    alone, holding one node a level.
    """
    some = np.flatnonzero(quotas)
    nodes = [(0, shards, some, np.asarray(quotas, np.int64)[some], np.zeros(len(some), np.int64))]
    while nodes:
        at, n, nth, quota, first = nodes.pop()
        if not len(nth) or at + n <= low or (high is not None and at >= high):
            continue
        if n == 1:
            yield at, nth, first, quota
            continue
        left = n // 2
        half = np.random.default_rng([seed, at, n]).multivariate_hypergeometric(quota, int(quota.sum()) * left // n, method="marginals")
        for start, size, part, begin in ((at + left, n - left, quota - half, first + half), (at, left, half, first)):
            kept = part > 0
            nodes.append((start, size, nth[kept], part[kept], begin[kept]))


@dataclass
class Plan:
    """What each source (a position in the lists) contributes: its quota of block draws, and in the last block the documents before a cut."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    whole: list[int]
    bits: list[int]
    edges: list[int]  # the last block of the last pass, -1 where passes are whole
    cuts: list[tuple[int, int]]  # the key before which documents of that block are taken, and the words before that key
    quotas: np.ndarray
    shards: int
    seed: int


def _keyed(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.col(text_column), F.lit(seed)), 64 - _KEY_BITS)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.alias("size"), key.alias("key"), *more)


def _with(rows: DataFrame, columns: dict[str, list], sources: list, schema: str) -> DataFrame:
    """Rows with the columns of their source, which are sent to all tasks: at most MAX_SOURCES rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    table = rows.sparkSession.createDataFrame(list(zip(sources, *columns.values(), strict=True)), f"plan_source string, {schema}")
    return rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("plan_source"))).select(*rows.columns, *names)


def _block() -> Column:
    return F.expr(f"shiftright(key, {_KEY_BITS} - bits)")


def fit(rows: DataFrame, shards: int | None = None, seed: int = 7, max_repeats: int = 3) -> Plan:
    """The plan for rows (doc_id, source, size, key). Without a number of shards, it follows the size of the whole."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources, sizes = [r["source"] for r in found], [r["size"] for r in found]
    target = targets(sizes, [1 + i % 3 for i in range(len(sizes))], max_repeats)
    whole = [int(t // s) if s else 0 for s, t in zip(sizes, target, strict=True)]
    rest = [float(t - w * s) for s, t, w in zip(sizes, target, whole, strict=True)]
    bits = [max(LEAST_BITS, (s // BLOCK_WORDS).bit_length()) for s in sizes]

    # the last block of each source before whose end the target is reached, and the cut in it
    planned = _with(rows, {"bits": bits, "rest": rest}, sources, "bits int, rest double").where("rest > 0")
    words = planned.groupBy("source", _block().alias("block"), "rest").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")
    edges = settled(words.withColumn("before", before).where("before < rest").groupBy("source").agg(F.max(F.struct("block", "before")).alias("edge")).select("source", "edge.*"))
    block_of = {r["source"]: r["block"] for r in edges.collect()}  # a row a source
    edge_rows = planned.join(F.broadcast(edges.withColumnsRenamed({"source": "edge_source", "block": "edge_block"})), F.col("source").eqNullSafe(F.col("edge_source")) & (_block() == F.col("edge_block")))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    at = edge_rows.withColumn("at", F.col("before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at = at.withColumn("unit", F.min("at").over(Window.partitionBy("source", "key")))
    left_out = F.col("at") + F.col("size") / 2 >= F.col("rest")
    cut_of = {r["source"]: (r["c"]["key"], r["c"]["unit"]) for r in at.where(left_out).groupBy("source").agg(F.min(F.struct("key", "unit")).alias("c")).collect()}

    edge = [block_of.get(x, -1) for x in sources]
    cuts = [cut_of.get(x) or (e + 1 << _KEY_BITS - b if e >= 0 else -1, 0) for x, e, b in zip(sources, edge, bits, strict=True)]
    quotas = np.array([(w << b) + e + 1 for w, e, b in zip(whole, edge, bits, strict=True)], np.int64)
    if quotas.sum() >= MAX_DRAWS:
        raise ValueError(f"more than {MAX_DRAWS} draws of blocks")
    return Plan(sources, sizes, target, whole, bits, edge, cuts, quotas, shards or max(LEAST_SHARDS, sum(sizes) // SHARD_WORDS), seed)


def drawn(spark: SparkSession, plan: Plan) -> DataFrame:
    """What the leaves draw: (draw_nth, draw_block, shards), the shards of a source's block in the order of its draws.

    Draw d of a source is block d mod 2^bits of its permuted blocks. Tasks walk to ranges of leaves.
    """
    parts = int(max(1, min(plan.shards, plan.quotas.sum() // PART_DRAWS)))
    sent = spark.sparkContext.broadcast((plan.quotas, np.array(plan.bits, np.int64), plan.shards, plan.seed))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotas, bits, shards, seed = sent.value
        for part in (int(p) for batch in batches for p in batch["id"]):
            held, n = [], 0
            for shard, nth, first, quota in runs(quotas, shards, seed, shards * part // parts, shards * (part + 1) // parts):
                held.append(pd.DataFrame({"nth": nth, "bits": bits[nth], "first": first, "n": quota, "shard": shard}))
                n += len(nth)
                if n > 100_000:
                    yield pd.concat(held)
                    held, n = [], 0
            if held:
                yield pd.concat(held)

    leaves = spark.range(0, parts, 1, parts).mapInPandas(walked, "nth int, bits int, first long, n long, shard int")
    draws = leaves.select("nth", "bits", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"))
    block = F.expr("draw & (shiftleft(1L, bits) - 1)")
    return draws.groupBy(F.col("nth").alias("draw_nth"), block.alias("draw_block")).agg(F.sort_array(F.collect_list(F.struct("draw", "shard")))["shard"].alias("shards"))


def dealt(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows (with source, size, key) with source_size, target, copies, taken and the shard of each copy: the draws of its block, without the last where the cut is before it."""
    columns = {"nth": range(len(plan.sources)), "source_size": plan.sizes, "target": list(map(float, plan.targets)), "whole": plan.whole, "bits": plan.bits, "edge": plan.edges, "cut": [c[0] for c in plan.cuts], "unit": [c[1] for c in plan.cuts]}
    full = _with(rows, columns, plan.sources, "nth int, source_size long, target double, whole int, bits int, edge long, cut long, unit long").withColumn("block", _block())
    cut_here = (F.col("block") == F.col("edge")) & (F.col("key") == F.col("cut"))
    plain = full.where(~cut_here).withColumn("left_out", (F.col("block") == F.col("edge")) & (F.col("key") > F.col("cut")))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at_cut = full.where(cut_here).withColumn("left_out", F.col("unit") + before + F.col("size") / 2 >= F.col("target") - F.col("whole") * F.col("source_size"))
    draws = drawn(rows.sparkSession, plan)
    draws = F.broadcast(draws) if plan.quotas.sum() <= SENT_DRAWS else draws
    joined = plain.unionByName(at_cut).join(draws, (F.col("nth") == F.col("draw_nth")) & (F.col("block") == F.col("draw_block")), "left")
    shards = F.coalesce("shards", F.array().cast("array<int>"))
    found = joined.withColumn("shards", F.slice(shards, 1, F.size(shards) - F.col("left_out").cast("int"))).withColumn("copies", F.size("shards"))
    return found.withColumn("taken", F.col("copies") * F.col("size")).drop(*columns.keys() - {"source_size", "target"}, "block", "left_out", "draw_nth", "draw_block")


def decisions(docs: DataFrame, shards: int | None = None, seed: int = 7, max_repeats: int = 3, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies and the shard of each copy."""
    rows = settled(_keyed(docs, seed, id_column, text_column, source_column))
    return dealt(rows, fit(rows, shards, seed, max_repeats)).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def mix(docs: DataFrame, shards: int | None = None, seed: int = 7, max_repeats: int = 3, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixture: each document as often as it is taken, dealt to shards and shuffled locally; columns as in docs."""
    keys = (seed, id_column, text_column, source_column)
    plan = fit(settled(_keyed(docs, *keys)), shards, seed, max_repeats)
    rows = dealt(_keyed(docs, *keys, F.struct(*[docs[c] for c in docs.columns]).alias("row")), plan)
    copies = rows.select("key", "row", F.posexplode("shards").alias("copy", "shard"))
    return copies.withColumn("order", F.xxhash64("key", "copy", F.lit(seed))).repartitionById(plan.shards, F.col("shard")).sortWithinPartitions("shard", "order").select("row.*")
