"""Near-duplicate classes and exact top-k search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstream.llm import near_dup, topk

DOCS = "doc_id long, text string, component_id string"


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, families=12, copies=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own)))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, "  "), (i + 3, "Two words"), (i + 4, "two WORDS")]


@pytest.mark.parametrize(("width", "percent", "leaf", "group"), [(3, 85, 1024, 4_000_000), (5, 80, 4, 4_000_000), (3, 85, 1024, 10)])
def test_classes_equal_brute_force(spark, width, percent, leaf, group, monkeypatch):
    monkeypatch.setattr(near_dup.resolved, "__defaults__", (group,))
    rows = corpus(width + leaf)
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.classes(docs, width, percent, leaf).collect()}
    assert found == brute(rows, width, percent)


def templated(pairs):
    """Documents that all agree on 82.6 percent of their words, and each with one partner on 85.7."""
    core = [f"c{k}" for k in range(200)]
    for i in range(2 * pairs):
        own = [f"p{i // 2}_{k}" for k in range(4)] + [f"o{i}_{k}" for k in range(17)]
        yield i, " ".join(core + own)


@pytest.mark.parametrize("leaf", [1024, 16])
def test_links_among_many_near_misses(spark, leaf):
    rows = list(templated(75))
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.classes(docs, 1, 85, leaf).collect()}
    assert found == brute(rows, 1, 85)


def test_classes_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "a b c d e f", "x"), (7, "a b c d e f", "x")], DOCS)
    rows = near_dup.classes(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(2, 2, True), (2, 2, True), (7, 2, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert near_dup.keep(docs).columns == docs.columns and near_dup.classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_keep_by_either_way_and_with_clashing_names(spark, sent):
    rows = [(i, f"the same {i // 3} few words said again", "x", i) for i in range(30)] + [(None, "the same 0 few words said again", None, None), (31, None, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, gone_doc_id long")
    kept = near_dup.keep(docs, sent_ids=sent)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [*((False, i) for i in range(0, 30, 3)), (False, 31), (True, None)]


def test_true_links_among_near_misses_by_groups():
    """Groups of 202 sets in which one pair only is linked: X and Y at 0.869, all others of X at 0.848. A cell loses none of 200."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        core = rng.integers(0, 1 << 62, 279)
        sets = [np.unique(np.concatenate([core, rng.integers(0, 1 << 62, 27)])) for _ in range(202)]
        shared = rng.integers(0, 1 << 62, 5)
        sets[0], sets[1] = np.unique(np.concatenate([core, shared, rng.integers(0, 1 << 62, 18)])), np.unique(np.concatenate([core, shared, rng.integers(0, 1 << 62, 23)]))
        sizes = np.array(list(map(len, sets)))
        slots = np.frombuffer(b"".join(near_dup.signatures([s.view(np.uint64) for s in sets])), np.uint16).reshape(202, -1)
        component, side = np.arange(202), np.full(202, 2)
        flagged = near_dup.crossing(component, side, sizes, slots, 0, 85, near_dup.least_estimate(85))
        own = np.flatnonzero(flagged)
        assert {0, 1} <= set(own.tolist())
        few = [sets[i] for i in own]
        links = near_dup.linked(component[own], side[own], np.concatenate(few), sizes[own], 85)
        assert [tuple(sorted(x)) for x in links] == [(0, 1)]


def test_signatures_in_steps(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 62, n)).view(np.uint64) for n in (5, 0, 300, 1, 40, 5000, 3)]
    whole = near_dup.signatures(sets)
    monkeypatch.setattr(near_dup, "STEP_SHINGLES", 64)
    assert near_dup.signatures(sets) == whole == [near_dup.signatures([s])[0] for s in sets]


def test_chance_that_no_order_meets():
    """Pairs at the threshold share the first slots of at least one of the orders."""
    rng = np.random.default_rng(6)
    lost = 0
    for _ in range(2000):
        core, a, b = rng.integers(0, 1 << 62, 170), rng.integers(0, 1 << 62, 15), rng.integers(0, 1 << 62, 15)  # 170 of 200
        x, y = (np.frombuffer(s, np.uint16) for s in near_dup.signatures([np.unique(np.concatenate([core, p])).view(np.uint64) for p in (a, b)]))
        same = x == y
        step = near_dup.SLOTS // near_dup.TREES
        lost += not any(same[t * step : t * step + near_dup.DEPTHS[0]].all() for t in range(near_dup.TREES))
    assert lost == 0


def test_rows_that_share_an_id_are_one_document(spark):
    base = [f"word{i}" for i in range(60)]
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, " ".join(base)), (2, " ".join([*base[:59], "changed"])), (2, other), (3, other), (4, " ".join(base)), (4, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(*r, "x") for r in order], DOCS)
        found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.classes(docs, 3, 85).collect())
        assert [f[0] for f in found] == [1, 2, 2, 3, 4, 4] and found[1] == found[2] and found[4] == found[5] == (4, 0, 4)
        assert (found[1][2], found[3][2]) in {(1, 3), (2, 2)}  # as one of its texts says, the same in any order
        first = found if order is rows else first
        assert found == first


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)]
    found = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[150] == found[200] == found[100] == 100


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist(), i) for i in range(700)]
    rows += [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * 8, 1), (703, [float("inf")] * 8, 1), (720, rows[3][1], 1), (740, [0.5], 1), (None, [1.0] * 8, 1), (20, rows[20][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = {}
    for r in topk.search(vectors, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))).astype(int)) for i, v, _ in rows if i is not None and i not in (700, 701, 702, 703)]
    queries = {i: v for i, v in good if i % 20 == 0}
    assert set(found) == set(queries)
    for i, q in queries.items():
        best = sorted(((-int(q @ v), j) for j, v in good if j != i))[:20]
        assert sorted(found[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    in_turns = topk.search(vectors, F.col("vec_id") % 20 == 0, k=20, query_bytes=512)
    assert sorted(map(tuple, in_turns.collect())) == sorted((q, *r) for q, rows in found.items() for r in rows)
    share = topk.pruned(vectors, F.col("vec_id") % 20 == 0).first()
    assert 0 < share["scored"] <= share["pairs"]


def test_pruned_blocks_cannot_matter():
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.integers(-3, 4, (600, 6)), rng.integers(40, 60, (600, 6))])
    queries = rng.integers(1, 5, (5, 6))
    at, ids, scores, scored = topk.search_slab(queries, np.full(5, -1), rows, np.arange(1200), 10)
    for q in range(5):
        best = sorted((-int(queries[q] @ rows[j]), j) for j in range(1200))[:10]
        assert sorted(zip((-scores[at == q]).tolist(), ids[at == q].tolist(), strict=True)) == best
    assert scored < 5 * 5  # blocks of small rows are never scored


def test_sums_beyond_64_bits_are_refused(spark):
    large = [(i, [1e9 + i] * 8) for i in range(4)]
    fits, too_large, beyond = ([(i, [x * f for x in v]) for i, v in large] for f in (1e-2, 1.0, 1e30))
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(frame(fits), F.col("vec_id") == 0, k=3).collect()
    terms = {i: np.floor(64 * np.array(v)).astype(int).astype(object) for i, v in fits}
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == sorted(((j, int((terms[0] * terms[j]).sum())) for j in (1, 2, 3)), key=lambda x: (-x[1], x[0]))
    for rows in (too_large, beyond):
        with pytest.raises(ValueError, match="may not fit"):
            topk.search(frame(rows), F.col("vec_id") == 0, k=3)


def test_most_blocks_of_clustered_slab_are_pruned():
    """A full slab of vectors about 64 centres: their order puts a cluster together, so bounds tell blocks apart; results stay those of brute force."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 61, (64, 16))
    rows = centres[rng.integers(0, 64, topk.SLAB_ROWS)] + rng.integers(-2, 3, (topk.SLAB_ROWS, 16))
    queries = rows[:40]
    at, ids, scores, scored = topk.search_slab(queries, np.arange(40), rows, np.arange(len(rows)), 20)
    for q in range(40):
        s = rows @ queries[q]
        best = sorted((-int(s[j]), j) for j in np.argsort(-s, kind="stable")[:400] if j != q)[:20]
        assert sorted(zip((-scores[at == q]).tolist(), ids[at == q].tolist(), strict=True)) == best
    blocks = 40 * topk.SLAB_ROWS // topk.BLOCK_ROWS
    assert scored < blocks / 4, f"{scored} of {blocks}"
