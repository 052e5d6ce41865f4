"""MinHash near-dedup by an LSH forest.

A document's set holds its distinct word shingles; documents are linked where
100 * |intersection| >= percent * |union|, and a component is what links reach.

1. One pass hashes each text's shingles and keeps the set's size, a 128-bit digest
   of the set and a signature of SLOTS min-hashes. Documents with equal sets are
   one node from here on, named by their smallest id.
2. Forest: each of TREES orders reads the signature's slots from another place.
   Nodes whose slots agree down to a depth form a region. A region of at most
   `leaf` nodes is a leaf; a larger one is looked at one level deeper, so depth
   adapts to the region, and its nodes are also compared with the centres of its
   largest leaves. In a leaf of the first FIRST_TREES orders the
   longest-common-prefix neighbours are compared by signature; proposed are the
   edges of a maximum spanning forest, which has each node's most similar
   neighbour, and those to the leaf's centre: linear in the leaf's size. These
   first proposals only join quickly what is alike; step 4 looks at all the rest,
   in all orders.
3. Proposed links fall into groups, the components of all proposals, found by
   large-star and small-star rounds. Groups are packed into buckets of bounded
   size, and each node's full set is sent to its bucket once; there the links are
   confirmed on full sets, best first, where their ends are not yet connected.
   A group beyond the bound is confirmed by joins instead: each node's best link,
   then all links whose ends are still in different components.
4. Then all pairs of each region of the first depth that are still in different
   components are looked at: a cell, one region or two blocks of a large one,
   compares signatures and names the nodes that have a possible link in it (a pair
   that shares an earlier order's region is left to that). Their full sets go to
   the cell, which counts the common shingles of all its pairs by postings and
   gives back the links between components, at most one fewer than there are
   nodes. Pairs are never rows. The blocks of a region's largest component are not
   compared with each other, so the work is quadratic only in the nodes of a
   region that the first links leave apart, and is spread over cells.

Nothing but counts reaches the driver, no group is gathered in one task beyond
`leaf` nodes, and hot regions, hubs and digests are split by salt or by AQE.

Defined results: a document without words or text, or without id, has an empty
set or no part, and links with nothing (without id: component null, kept);
a text of fewer words than a shingle has its whole word sequence as its one
shingle; rows that share an id are one document, of several texts the one whose
set has the smallest digest (an empty one first); an empty table gives no rows;
other columns are ignored, and `keep` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, forget, settled

#: Min-hashes of a signature, two bytes each, and sorted orders of them.
SLOTS, TREES = 128, 16
#: Orders whose leaves make the first proposals; all orders are looked at after them.
FIRST_TREES = 8
#: Depths at which regions are cut, and nodes of a leaf.
DEPTHS, LEAF = (3, 5, 8, 12, 18, 28, 48), 1024
#: Centres that a large region is compared with.
CENTRES = 4
#: Signatures that agree on less than the wanted share minus this many standard errors are not proposed.
ERRORS = 4.0
#: Shingles that are hashed for all slots at once.
STEP_SHINGLES = 1 << 16
SALTS = 32
#: Ids (8 bytes each) of documents to drop that are sent to all tasks at most.
SENT_IDS = 1_000_000
#: Binary logarithm of the most bits of the filter of proposed nodes (16 MB).
MAX_FILTER_BITS = 27
#: Shingles of all sets of a group, and of a bucket of groups, that one task confirms.
GROUP_SHINGLES, BUCKET_SHINGLES = 4_000_000, 2_000_000

RESULT_SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"

_random = np.random.default_rng(20240117)
_TIMES = _random.integers(1, 1 << 32, SLOTS, np.uint64).astype(np.uint32) | np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, SLOTS, np.uint64).astype(np.uint32)
_FACTORS = _random.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    split = [(t or b"").lower().split() for t in texts]
    known: dict[bytes, int] = {w: xxhash.xxh3_64_intdigest(w) for w in set(chain.from_iterable(split))}
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
    out, at = [], 0
    for s in split:
        w = flat[at : at + len(s)]
        at += len(s)
        n = max(1, len(w) - width + 1) if len(w) else 0
        size = min(width, len(w))
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = _mixed(h * _FACTORS[0] + w[k : k + n])
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """SLOTS two-byte min-hashes of each set; none for an empty one."""
    out: list[bytes | None] = [None] * len(sets)
    start, held = 0, 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= 4096 or i + 1 == len(sets):
            own = [j for j in range(start, i + 1) if len(sets[j])]
            if own:
                begin = np.cumsum([0, *(len(sets[j]) for j in own[:-1])])
                x = np.concatenate([sets[j] for j in own])
                x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
                low = np.full((len(own), SLOTS), 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), STEP_SHINGLES):  # a long text alone takes several steps
                    first = np.searchsorted(begin, at, side="right") - 1
                    cuts = np.append(at, begin[first + 1 : np.searchsorted(begin, at + STEP_SHINGLES)]) - at
                    for c in range(0, SLOTS, 32):
                        part = np.minimum.reduceat(x[at : at + STEP_SHINGLES, None] * _TIMES[c : c + 32] + _PLUS[c : c + 32], cuts, axis=0)
                        rows = low[first : first + len(cuts), c : c + 32]
                        np.minimum(rows, part, out=rows)
                low = (low * np.uint32(2654435761)) >> np.uint32(16)
                for j, row in zip(own, low.astype(np.uint16), strict=True):
                    out[j] = row.tobytes()
            start, held = i + 1, 0
    return out


def sketched(docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                sets = shingle_sets(texts, width)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(signatures(sets), pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (a == b).mean(axis=-1, dtype=np.float32)


def propose(ids: np.ndarray, sizes: np.ndarray, slots: np.ndarray, percent: int, least: float) -> tuple[list[np.ndarray], int]:
    """Edges (two positions and an estimate) of one leaf, and the position of its centre."""
    n = len(ids)
    near = np.empty((n, n), np.float32)
    for i in range(n):
        near[i] = agreement(slots[i], slots)
    fits = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    centre = int(np.argmax(near.sum(axis=1)))
    near[(near < least) | ~fits] = 0
    np.fill_diagonal(near, 0)
    wanted = np.zeros((n, n), bool)
    wanted[:, centre] = True
    inside, weight, link = np.zeros(n, bool), near[centre].copy(), np.full(n, centre)
    inside[centre] = True
    for _ in range(n - 1):  # Prim's maximum spanning tree; edges of weight 0 fall out below
        j = int(np.argmax(np.where(inside, -1, weight)))
        inside[j] = True
        wanted[link[j], j] = True
        closer = near[j] > weight
        weight[closer], link[closer] = near[j][closer], j
    a, b = np.nonzero(wanted & (near > 0))
    return [a, b, near[a, b]], centre


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("estimate", pa.float32()), ("tree", pa.int32()), ("region", pa.binary()), ("centre", pa.int64()), ("centre_shingles", pa.int64()), ("centre_signature", pa.binary()), ("leaf_nodes", pa.int64())])
_EDGE_SCHEMA = "a long, b long, estimate float, tree int, region binary, centre long, centre_shingles long, centre_signature binary, leaf_nodes long"


def _leaves(percent: int, least: float):
    """A function over rows sorted by (tree, region, node): edges of each leaf, and a row for its centre where the region lies in a larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and (not batch.num_rows or sum(b.num_rows for b in held) < 4096)):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            tree, region = np.asarray(table.column("tree")), table.column("region").to_pylist()
            change = np.array([True, *(tree[i] != tree[i - 1] or region[i] != region[i - 1] for i in range(1, len(tree)))])
            starts = [*np.flatnonzero(change).tolist(), len(tree)]
            if batch is not None:  # the last region may go on
                starts.pop()
            rest = starts[-1]
            held = table.slice(rest).to_batches() if rest < len(tree) else []
            ids, sizes = np.asarray(table.column("node")), np.asarray(table.column("n_shingles"))
            slots = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(ids), SLOTS)
            out: list[dict] = []
            for i, j in zip(starts, starts[1:], strict=False):
                if j - i < 2:
                    continue
                (x, y, estimate), centre = propose(ids[i:j], sizes[i:j], slots[i:j], percent, least)
                a, b = ids[i + x], ids[i + y]
                out += [{"a": p, "b": q, "estimate": e} for p, q, e in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), estimate.tolist(), strict=True)]
                if len(region[i]) > 2 * DEPTHS[0]:
                    out.append({"tree": int(tree[i]), "region": region[i], "centre": int(ids[i + centre]), "centre_shingles": int(sizes[i + centre]), "centre_signature": slots[i + centre].tobytes(), "leaf_nodes": j - i})
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, _EDGES)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _EDGES)

    return run


def _stars(percent: int, least: float):
    """A function over pairs (node, centre) with signatures: those that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("signature", "centre_signature"))
            n, m, a, b = (np.asarray(batch.column(c)) for c in ("n_shingles", "centre_shingles", "node", "centre"))
            estimate = agreement(x, y)
            good = (estimate >= least) & (a != b) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good]), pa.array(estimate[good])], names=["a", "b", "estimate"])

    return run


def crossing(component: np.ndarray, side: np.ndarray, sizes: np.ndarray, slots: np.ndarray, tree: int, percent: int, least: float) -> np.ndarray:
    """Which nodes of a cell may have a link to another component; pairs of one side are left to another cell, unless the side is 2, and pairs that share the region of an earlier order to that."""
    names, own, counts = np.unique(component, return_inverse=True, return_counts=True)
    flagged, done = np.zeros(len(own), bool), np.zeros(len(own), bool)
    places = (np.arange(tree) * (SLOTS // TREES))[:, None] + np.arange(DEPTHS[0])
    for i in np.flatnonzero(own != counts.argmax()).tolist():
        done[i] = True
        fits = 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        others = np.flatnonzero(~done & (own != own[i]) & ((side != side[i]) | (side == 2)) & fits)
        equal = slots[i] == slots[others]
        good = equal.mean(axis=1, dtype=np.float32) >= least
        others = others[good]
        if tree and len(others):
            others = others[~equal[good][:, places].all(axis=2).any(axis=1)]
        flagged[others] = True
        flagged[i] |= len(others) > 0
    return flagged


def linked(component: np.ndarray, side: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of components of a cell that a link joins, those of a spanning forest, by the sets (flat, one after another)."""
    n = len(sizes)
    _, item = np.unique(flat, return_inverse=True)
    node = np.repeat(np.arange(n), sizes)
    posted = node[np.argsort(item, kind="stable")]
    count_of = np.bincount(item)
    first = np.cumsum(count_of) - count_of
    ends = np.cumsum(sizes)
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    _, own, members = np.unique(component, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(own != members.argmax()).tolist():
        mine = item[ends[i] - sizes[i] : ends[i]]
        size = count_of[mine]
        at = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        common = np.bincount(posted[at], minlength=n)
        hits = (100 * common >= percent * (sizes + sizes[i] - common)) & (own != own[i]) & ((side != side[i]) | (side == 2))
        for j in np.flatnonzero(hits).tolist():
            a, b = find(int(component[i])), find(int(component[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((a, b))
    return out


def _by_cell(columns: list[str], of_cell):
    """A function over rows sorted by cell that gives each cell's rows, as a table, to of_cell, which returns a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and (not batch.num_rows or sum(b.num_rows for b in held) < 4096)):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cell = np.asarray(table.column("cell"))
            starts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            if batch is not None:  # the last cell may go on
                starts.pop()
            rest = starts[-1]
            held = table.slice(rest).to_batches() if rest < len(cell) else []
            for i, j in zip(starts, starts[1:], strict=False):
                yield of_cell(table.slice(i, j - i), columns)

    return run


def unlinked(nodes: DataFrame, regions: DataFrame, named: DataFrame, docs: DataFrame, width: int, percent: int, id_column: str, text_column: str, several: bool, leaf: int = LEAF) -> DataFrame:
    """Pairs (a, b) of components of named (node, component; a node that is not in it is its own) that links within regions (tree, region, node) join.

    A region of more than `leaf` nodes, or of more than GROUP_SHINGLES shingles, is
    dealt into blocks of half as many, and each pair of blocks is a cell of its
    own. Its largest component's blocks are not compared with each other.
    """
    sized = regions.join(nodes.select("node", "n_shingles"), "node")
    rows = settled(sized.join(named, "node", "left").select("tree", "region", "node", "n_shingles", F.coalesce("component", "node").alias("component")))
    parts = rows.groupBy("tree", "region", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    largest = F.max(F.struct("n", "component", "weight"))
    parts = parts.groupBy("tree", "region").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), largest.alias("major"), F.count("*").alias("parts")).where("parts > 1")
    whole = (F.col("n") <= leaf) & (F.col("weight") <= GROUP_SHINGLES)
    blocks = lambda n, weight: F.greatest(F.ceil(n / (leaf / 2)), F.ceil(weight / (GROUP_SHINGLES / 2)), F.lit(1)).cast("long")
    minors, majors = blocks(F.col("n") - F.col("major.n"), F.col("weight") - F.col("major.weight")), blocks(F.col("major.n"), F.col("major.weight"))
    at = rows.join(parts.select("tree", "region", whole.alias("whole"), F.col("major.component").alias("largest"), minors.alias("minors"), majors.alias("majors")), ["tree", "region"])
    minor, code = F.col("component") != F.col("largest"), F.xxhash64("node")
    block = F.when(F.col("whole"), 0).when(minor, F.pmod(code, "minors")).otherwise(F.col("minors") + F.pmod(code, "majors"))
    others = F.when(F.col("whole"), 0).when(minor, F.col("minors") + F.col("majors") - 1).otherwise(F.col("minors") - 1)
    cells = at.select("tree", "region", "node", "component", block.cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), others.cast("long"))).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    cells = cells.select(F.xxhash64("tree", "region", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "tree", side.alias("side"), "node", "component")
    least, keys = least_estimate(percent), ["cell", "side", "node", "component"]

    def flag(table: pa.Table, columns: list[str]) -> pa.RecordBatch:
        component, side, sizes = (np.asarray(table.column(c)) for c in ("component", "side", "n_shingles"))
        slots = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(sizes), SLOTS)
        good = crossing(component, side, sizes, slots, int(table.column("tree")[0].as_py()), percent, least)
        return table.select(columns).filter(pa.array(good)).combine_chunks().to_batches()[0] if good.any() else pa.RecordBatch.from_pylist([], table.select(columns).schema)

    def join(table: pa.Table, columns: list[str]) -> pa.RecordBatch:
        items = table.column("items").combine_chunks()
        pairs = linked(np.asarray(table.column("component")), np.asarray(table.column("side")), np.asarray(items.flatten()), np.asarray(items.value_lengths(), np.int64), percent)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=columns)

    full = cells.join(nodes, "node").repartition("cell").sortWithinPartitions("cell")
    flagged = settled(full.select(*keys, "tree", "n_shingles", "signature").mapInArrow(_by_cell(keys, flag), "cell long, side int, node long, component long"))
    sets = _set_rows(docs, flagged.select("node").distinct(), nodes if several else None, width, id_column, text_column)
    spread = flagged.join(sets.dropDuplicates(["node"]), "node").repartition("cell").sortWithinPartitions("cell")
    return spread.select(*keys, "items").mapInArrow(_by_cell(["a", "b"], join), "a long, b long").distinct()


def merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, component) of first after its components have been joined by links (a, b) between them or nodes that it has not."""
    again = settled(components(links))
    alone = again.join(first, "node", "left_anti")
    whole = again.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return first.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(alone)


def least_estimate(percent: int) -> float:
    """The estimate below which a pair is no link but by rare chance."""
    return percent / 100 - ERRORS * (percent / 100 * (1 - percent / 100) / SLOTS) ** 0.5


def candidates(nodes: DataFrame, percent: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Proposed links (a, b, estimate) between nodes (node, n_shingles, signature), and the regions (tree, region, node) of the first depth."""
    least = least_estimate(percent)
    twice = F.concat("signature", "signature")
    step = 2 * (SLOTS // TREES)
    rows = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), twice.alias("path"))
    rows = rows.select("node", "tree", F.expr(f"substring(path, tree * {step} + 1, {2 * DEPTHS[-1]})").alias("path"))
    edges, large = [], rows
    for level, depth in enumerate(DEPTHS):
        last = level + 1 == len(DEPTHS)
        whole = large.withColumn("region", F.expr(f"substring(path, 1, {2 * depth})"))
        sizes = settled(whole.groupBy("tree", "region").agg(F.count("*").alias("n")).where("n > 1"))
        big = settled(sizes.where((F.col("n") > leaf) & (F.col("tree") < FIRST_TREES)).select("tree", "region"))  # few, so that paths need no shuffle
        at = whole.select("tree", "region", "node").join(sizes, ["tree", "region"])
        if level == 0:
            at = settled(at)
            regions = at.select("tree", "region", "node")
            at = at.where(F.col("tree") < FIRST_TREES)
        small = at.where(F.col("n") <= leaf)
        if last:  # nodes that agree on all these slots: leaves of chunks, and each node against its region's centres
            chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (leaf / 2)).cast("long"))
            small = small.unionByName(at.where(F.col("n") > leaf).withColumn("region", F.concat("region", chunk.cast("string").cast("binary"))))
        full = small.select("tree", "region", "node").join(nodes, "node")
        spread = full.repartition(F.col("tree"), F.col("region")).sortWithinPartitions("tree", "region", "node")
        found = settled(spread.select("tree", "region", "node", "n_shingles", "signature").mapInArrow(_leaves(percent, least), _EDGE_SCHEMA))
        edges.append(found.where("centre IS NULL").select("a", "b", "estimate"))
        centres = found.where("centre IS NOT NULL").select("tree", "region", "centre", "centre_shingles", "centre_signature", "leaf_nodes")
        all_centres = centres if level == 0 else all_centres.unionByName(centres)  # noqa: F821
        if last or big.isEmpty():
            break
        large = settled(whole.join(big, ["tree", "region"], "left_semi").select("node", "tree", "path"))
        found_large = large.withColumn("region", F.expr(f"substring(path, 1, {2 * depth})")).select("node", "tree", "region")
        all_large = found_large if level == 0 else all_large.unionByName(found_large)  # noqa: F821
    else:
        level = len(DEPTHS) - 1
    if level == 0:
        return edges[0], regions
    # centres of the largest leaves below each large region
    above = F.array(*[F.expr(f"substring(region, 1, {2 * d})") for d in DEPTHS[:level]])
    under = all_centres.withColumn("own", F.col("region")).withColumn("region", F.explode(above)).where(F.octet_length("own") > F.octet_length("region"))
    top = Window.partitionBy("tree", "region").orderBy(F.desc("leaf_nodes"), "centre")
    under = under.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= CENTRES).drop("rank", "own", "leaf_nodes")
    under = under.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = all_large.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(under, ["tree", "region", "salt"]).select("node", "centre", "centre_shingles", "centre_signature")
    pairs = pairs.dropDuplicates(["node", "centre"]).join(nodes, "node").select("node", "n_shingles", "signature", "centre", "centre_shingles", "centre_signature")
    edges.append(pairs.mapInArrow(_stars(percent, least), "a long, b long, estimate float"))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out, regions


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): the smallest node that each reaches, by alternating large-star and small-star rounds."""
    now, before = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        held, large = now, settled(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        now = settled(small)
        forget(held)
        forget(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def _filter_bits(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash of a node, as bytes, and the number of bits, which is bounded: with more nodes more hashes share a bit."""
    n = nodes.count()
    bits = 1 << min(MAX_FILTER_BITS, max(16, (32 * n).bit_length()))
    at = F.pmod(F.xxhash64("node"), F.lit(bits))
    parts = 64

    def pack(key, rows):
        own = np.zeros(bits // parts, bool)
        own[np.asarray(rows.column("bit"))] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([np.packbits(own).tobytes()], pa.binary())})

    found = nodes.select(at.alias("bit")).select((F.col("bit") % parts).alias("part"), F.floor(F.col("bit") / parts).alias("bit")).distinct()
    out = np.zeros((parts, bits // parts // 8), np.uint8)
    for r in found.groupBy("part").applyInArrow(pack, "part long, packed binary").collect():  # at most 64 rows
        out[r["part"]] = np.frombuffer(r["packed"], np.uint8)
    return out, bits


def _set_rows(docs: DataFrame, wanted: DataFrame, nodes: DataFrame | None, width: int, id_column: str, text_column: str) -> DataFrame:
    """Rows (node, items) with the full sets of the wanted nodes and, by chance, of a few others: a filter of bounded size spares the shuffle of texts.

    Where ids may have several texts, nodes (node, digest) tells which set counts.
    """
    filter_bits, bits = _filter_bits(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            bit = np.asarray(batch.column("bit"))
            part, at = bit % len(table), bit // len(table)
            for few, texts in byte_slices(batch.filter(pa.array((table[part, at >> 3] >> (7 - (at & 7))) & 1 == 1)), "text", 1 << 20):
                sets = [s.view(np.int64) for s in shingle_sets(texts, width)]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([few.column("node"), pa.array(sets, pa.list_(pa.int64())), pa.array(digests, pa.binary())], names=["node", "items", "digest"])

    rows = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).alias("text")).where(F.col("node").isNotNull() & F.col("text").isNotNull())
    found = rows.select("node", "text", F.pmod(F.xxhash64("node"), F.lit(bits)).alias("bit")).mapInArrow(run, "node long, items array<long>, digest binary")
    return (found if nodes is None else found.join(nodes.select("node", "digest"), ["node", "digest"], "left_semi")).select("node", "items")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the edges (a, b) that are links by their full sets."""
    left = edges.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _bucket_components(percent: int):
    """The function that confirms a bucket's links on its sets and names each node's component."""

    def run(sets, edges):
        items = sets.column("items").combine_chunks()
        flat, ends = np.asarray(items.flatten()), np.cumsum(np.asarray(items.value_lengths()))
        of = dict(zip(sets.column("node").to_pylist(), np.split(flat, ends[:-1]), strict=True)) if len(ends) else {}
        root = {n: n for n in of}

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        estimate = np.asarray(edges.column("estimate"))
        left, right = np.asarray(edges.column("a")), np.asarray(edges.column("b"))
        for i in np.argsort(-estimate, kind="stable"):
            a, b = int(left[i]), int(right[i])
            x, y = find(a), find(b)
            if x != y:
                common = len(np.intersect1d(of[a], of[b], assume_unique=True))
                if 100 * common >= percent * (len(of[a]) + len(of[b]) - common):
                    root[max(x, y)] = min(x, y)
        nodes = list(of)
        return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([find(n) for n in nodes], pa.int64())})

    return run


def _by_buckets(edges: DataFrame, full: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Rows (node, component) from links (a, b, estimate, group) and sets (node, items, group)."""
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket")
    left, right = full.select(bucket, "node", "items"), edges.select(bucket, "a", "b", "estimate")
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_bucket_components(percent), "node long, component long")


def _by_joins(edges: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The same for groups too large for one task."""
    ends = edges.select("a", "b", "estimate", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", F.negative("a"), F.negative("b"))).alias("e")).select("e.*").distinct()
    links = settled(confirmed(best, full, percent))
    first = components(links)
    of = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    open_ = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b"))
    more = settled(confirmed(open_.join(best, ["a", "b"], "left_anti"), full, percent))
    return first if more.isEmpty() else components(links.unionByName(more))


def resolved(proposed: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, id_column: str, text_column: str, several: bool, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Rows (node, component) for the nodes of proposed links (a, b, estimate), confirmed on full sets; nodes has (node, n_shingles, digest)."""
    groups = settled(components(proposed).withColumnRenamed("component", "group"))
    edges_in = proposed.join(groups.select(F.col("node").alias("a"), "group"), "a").select("group", F.lit(1).cast("long").alias("n_shingles"))  # a link takes memory like a shingle
    weight = groups.join(nodes, "node").select("group", "n_shingles").unionByName(edges_in).groupBy("group").agg(F.sum("n_shingles").alias("weight"))
    large = settled(weight.where(F.col("weight") > group_shingles).select("group", F.lit(True).alias("large")))
    total = weight.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    full = settled(_set_rows(docs, groups.select("node"), nodes if several else None, width, id_column, text_column))
    grouped_sets = full.join(groups, "node").join(large, "group", "left")
    grouped_edges = proposed.join(groups.select(F.col("node").alias("a"), "group"), "a").join(large, "group", "left")
    small = "large IS NULL"
    out = _by_buckets(grouped_edges.where(small), grouped_sets.where(small), max(1, -(-total // BUCKET_SHINGLES)), percent)
    if not large.isEmpty():
        out = out.unionByName(_by_joins(settled(grouped_edges.where("large").select("a", "b", "estimate")), full, percent))
    return out


def classes(docs: DataFrame, width: int = 5, percent: int = 80, leaf: int = LEAF, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document (RESULT_SCHEMA)."""
    rows = settled(sketched(docs, width, id_column, text_column))
    set_of = F.coalesce("digest", F.lit(b""))
    several = settled(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(set_of).alias("first"), F.max(set_of).alias("last")).where("first <> last").select("doc_id", "first"))
    if repeated := not several.isEmpty():
        texts = rows.join(several, "doc_id").where(set_of == F.col("first")).groupBy("doc_id").agg(F.first(F.struct("n_shingles", "digest", "signature")).alias("one"))
        rows = settled(rows.join(texts, "doc_id", "left").select("doc_id", *[F.when(F.col("one").isNotNull(), F.col(f"one.{c}")).otherwise(F.col(c)).alias(c) for c in ("n_shingles", "digest", "signature")]))
    sets = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    sets = settled(sets)
    nodes = sets.select("node", "n_shingles", "signature", "digest")
    edges, regions = candidates(nodes, percent, leaf)
    proposed = settled(edges.groupBy("a", "b").agg(F.max("estimate").alias("estimate")))
    joined = settled(resolved(proposed, nodes, docs, width, percent, id_column, text_column, repeated).dropDuplicates(["node"]))
    links = settled(unlinked(nodes, regions, joined, docs, width, percent, id_column, text_column, repeated, leaf))
    if not links.isEmpty():
        joined = settled(merged(joined, links))
    named = sets.where("copies > 1").select("digest", "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.select("doc_id", "n_shingles", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(named.hint("merge"), ["digest", "salt"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    spread = joined.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = out.join(spread.hint("merge"), ["node", "salt"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", sent_ids: int = SENT_IDS) -> DataFrame:
    """The documents that stand for their component, all columns unchanged.

    Up to sent_ids ids that go are sent to all tasks. With more, only the documents
    that a filter of bounded size lets through meet them in a shuffle.
    """
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = settled(classes(docs, width, percent, id_column=id_column, text_column=text_column).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    if gone.count() <= sent_ids:
        return docs.join(F.broadcast(gone), docs[id_column].cast("long") == gone[name], "left_anti")
    filter_bits, bits = _filter_bits(gone.select(F.col(name).alias("node")))
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits)
    schema, at = docs.schema, docs.columns.index(id_column)

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = np.asarray(batch.column(batch.num_columns - 1).fill_null(-1))
                table = sent.value
                maybe = (bit >= 0) & ((table[bit % len(table), bit // len(table) >> 3] >> (7 - (bit // len(table) & 7))) & 1 == 1)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([f for f in batch.schema][:-1])).filter(pa.array(maybe == hit))

        return run

    bit = F.pmod(F.xxhash64(F.col(docs.columns[at]).cast("long")), F.lit(bits))
    marked = docs.select("*", F.when(docs[id_column].isNotNull(), bit).alias(name))
    maybe = marked.mapInArrow(split(True), schema)
    return marked.mapInArrow(split(False), schema).unionByName(maybe.join(gone, maybe[id_column].cast("long") == gone[name], "left_anti"))
