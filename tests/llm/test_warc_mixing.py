"""WARC round trips and salvage; mixtures against a brute-force version."""

import random

import numpy as np
import pytest

from fieldstream.llm import mixing, warc
from fieldstream.llm.common import shared_dir

PAGES = "page_id long, url string, html string, payload int"


def test_round_trip(spark):
    long = "x" * 150
    rows = [(3, "http://a/é b", long, 1), (1, None, long, 1), (2, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (5, "u", None, 1), (None, "u", long, 1), (9, "u", "é" * 60_000, 1)]
    path = shared_dir(spark)
    warc.write(spark.createDataFrame(rows, PAGES), path)
    found = warc.read(spark, path).cache()
    assert warc.gaps(found).count() == 0
    got = sorted(((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.records(found).collect()))
    assert got == [(-1, "revisit", 1, 150), (1, "response", None, 150), (2, "response", None, 5), (3, "revisit", 1, 150), (4, "response", None, 5), (5, "response", None, 0), (5, "response", None, 0), (9, "response", None, 120_000)]
    assert next(r for r in warc.records(found).collect() if r["page_id"] == 9)["payload"].decode() == "é" * 60_000


def test_round_trip_of_long_addresses(spark):
    rows = [(1, "http://a/" + "x" * 100_000, "one", 1), (2, "http://a/" + "é" * 40_000, "two", 1), (3, "u", "three", 1)]
    path = shared_dir(spark)
    warc.write(spark.createDataFrame(rows, PAGES), path)
    found = warc.read(spark, path).cache()
    assert warc.gaps(found).count() == 0
    assert sorted((r["page_id"], len(r["url"]), r["payload"].decode()) for r in warc.records(found).collect()) == [(1, 100_009, "one"), (2, 9 + 6 * 40_000, "two"), (3, 1, "three")]


def test_no_pages(spark):
    path = shared_dir(spark)
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


def records(n):
    from hashlib import sha256

    return [warc.record_bytes(i, "u", b"payload %d" % i * 20, len(b"payload %d" % i * 20), sha256(b"payload %d" % i * 20).hexdigest(), None, False, "2024-01-01T00:00:00Z") for i in range(n)]


def test_salvage_after_broken_member():
    members = [warc.member(r) for r in records(5)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + members[2] + b"junk" + members[3] + members[4][:-9]
    found = list(warc.salvage(data))
    assert [x[4]["page_id"] for x in found if x[0] == "record"] == [0, 2, 3, 4]  # all of the last can be unpacked, though its member is cut
    gaps = [(x[1], x[2]) for x in found if x[0] == "gap"]
    a, b, c, d = (len(m) for m in members[:4])
    assert gaps == [(a, a + b), (a + b + c, a + b + c + 4), (a + b + c + 4 + d, len(data))]


def test_salvage_within_a_member():
    plain = records(4)
    bad = plain[1].replace(b"payload 1", b"PAYLOAD 1", 1)
    before, after = warc.member(records(6)[5]), warc.member(records(5)[4])
    whole = warc.member(plain[0] + bad + plain[2] + plain[3])
    found = list(warc.salvage(before + whole + after))
    assert [x[4]["page_id"] for x in found if x[0] == "record"] == [5, 0, 2, 3, 4]
    gap = [x for x in found if x[0] == "gap"]
    assert [(x[1], x[2], x[3], x[4]) for x in gap] == [(len(before), len(before + whole), "wrong digest", {"inner_start": len(plain[0]), "inner_stop": len(plain[0] + bad)})]


@pytest.mark.parametrize("fault", ["cut", "cut before others", "wrong check sum", "broken stream"])
def test_salvage_of_a_cut_or_broken_member(fault):
    rng = random.Random(7)
    plain = [r.replace(b"u\r\n", rng.randbytes(300).hex().encode() + b"\r\n", 1) for r in records(4)]  # addresses that do not compress
    after = warc.member(records(6)[5])
    data = bytearray(warc.member(b"".join(plain)))
    size = len(data)
    if fault == "wrong check sum":
        data[-6] ^= 0xFF
    elif fault == "broken stream":
        data[size * 5 // 8] ^= 0xFF
    else:
        del data[-30:]
    rest = b"" if fault == "cut" else after
    found = list(warc.salvage(bytes(data) + rest))
    ids = [x[4]["page_id"] for x in found if x[0] == "record"]
    assert ids[:2] == [0, 1] and (5 in ids) == bool(rest)
    assert (2 in ids) == (fault != "broken stream")
    gap = [x for x in found if x[0] == "gap"]
    assert all((x[1], x[2]) == (0, len(data)) for x in gap)
    if fault != "broken stream":  # after a fault the rest may still unpack, to other bytes
        assert (3 in ids) == (fault == "wrong check sum")
        assert [x[4]["inner_start"] for x in gap] == [sum(map(len, plain[: len(ids) - bool(rest)]))]
    else:
        assert gap[0][4]["inner_start"] == len(plain[0] + plain[1])


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    import os

    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    rows = [(i, "u", os.urandom(15_000).hex(), 1) for i in range(60)] + [(100, "u", os.urandom(300_000).hex(), 1)]
    path = shared_dir(spark)
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) >= 3 and max(sizes) < 16 * 40_000 + 400_000
    found = warc.read(spark, path).cache()
    assert warc.records(found).count() == 61 and warc.gaps(found).count() == 0


def test_hot_payload_is_not_joined_by_its_digest(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_GROUPS", 4)
    rows = [(i, "u", "h" * 200 if i % 3 else ("c" * 150 if i % 2 else f"own {i} " * 30), 1) for i in range(1, 100)]
    path = shared_dir(spark)
    warc.write(spark.createDataFrame(rows, PAGES), path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.records(warc.read(spark, path)).collect()}
    first = {}
    want = {i: ("response", None) if first.setdefault(h, i) == i else ("revisit", first[h]) for i, _, h, _ in rows}
    assert got == want


def test_salvage_of_plain_records():
    plain = records(4)
    data = plain[0] + plain[1].replace(b"payload 1", b"PAYLOAD 1", 1) + plain[2] + plain[3][:50]
    found = list(warc.salvage(data))
    assert [x[4]["page_id"] for x in found if x[0] == "record"] == [0, 2]
    assert sum(x[2] - x[1] for x in found if x[0] == "gap") == len(plain[1]) + 50


def test_targets_stop_at_caps():
    found = mixing.targets([10, 100, 1000], [1, 2, 3])
    assert found[0] == 30 and found[1] == 300 and abs(sum(found) - 1110) < 1e-6
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_quotas_are_split_exactly():
    quotas = np.array([7, 0, 130, 1], np.int64)
    parts, ends = np.zeros((8, 4), np.int64), np.zeros(4, np.int64)
    for shard, nth, first, n in mixing.runs(quotas, 8, 1):
        assert (first == ends[nth]).all() and (n > 0).all()
        parts[shard, nth] = n
        ends[nth] += n
    assert (ends == quotas).all() and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 3
    whole = [(s, *map(np.ndarray.tolist, r)) for s, *r in mixing.runs(quotas, 8, 1)]
    some = [(s, *map(np.ndarray.tolist, r)) for low, high in ((0, 3), (3, 4), (4, 8)) for s, *r in mixing.runs(quotas, 8, 1, low, high)]
    assert some == whole and not list(mixing.runs(np.zeros(3, np.int64), 4, 1))


def test_draws_name_the_copies(spark, monkeypatch):
    """Copies are the draws of a document's block by the tree's leaves, but for the cut in the last one; also where the draws are joined and walked to in parts."""
    rows = mixture_rows(5)
    docs = spark.createDataFrame(rows, DOCS)
    keyed = mixing._keyed(docs, 7, "doc_id", "text", "source").cache()
    plan = mixing.fit(keyed, shards=11)
    named = {}
    for shard, nth, first, n in mixing.runs(plan.quotas, 11, 7):
        for s, f, k in zip(nth.tolist(), first.tolist(), n.tolist(), strict=True):
            for d in range(f, f + k):
                named.setdefault((s, d % 2 ** plan.bits[s]), []).append((d, shard))
    shards_of = {k: [shard for _, shard in sorted(v)] for k, v in named.items()}
    sent = sorted(map(str, mixing.dealt(keyed, plan).collect()))
    for r in mixing.dealt(keyed, plan).collect():
        s = plan.sources.index(r["source"])
        block = r["key"] >> 53 - plan.bits[s]
        want = shards_of.get((s, block), [])
        assert r["shards"] == want or (block == plan.edges[s] and r["key"] >= plan.cuts[s][0] and r["shards"] == want[:-1])
        assert r["copies"] == len(r["shards"]) and r["taken"] == r["copies"] * r["size"]
    monkeypatch.setattr(mixing, "SENT_DRAWS", 0)
    monkeypatch.setattr(mixing, "PART_DRAWS", 500)
    assert sorted(map(str, mixing.dealt(keyed, plan).collect())) == sent


def test_shards_follow_the_size_for_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 30)
    docs = spark.createDataFrame([(i, f"word{i} " * 5, f"s{i}") for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.fit(mixing._keyed(docs, 7, "doc_id", "text", "source"))
    assert plan.shards == 400 * 5 // 30
    assert sum(r["copies"] for r in mixing.decisions(docs).collect()) > 300


DOCS = "doc_id long, text string, source string, copies int"


def mixture_rows(seed, n=800):
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", None, "c"][int(rng.integers(0, 4) * rng.integers(0, 2))], 1) for i in range(n)]
    return rows + [(900, None, "b", 1), (None, "w w", "c", 1), (1, "w", "a", 1), (1, "w", "a", 1)]


def brute_targets(rows):
    """Targets by pouring the whole size out in small steps of weight, and sizes by hand."""
    from fractions import Fraction

    size = {}
    for _, text, source, _ in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, Fraction(0)), Fraction(sum(size.values())), set(order)
    while left and open_:
        room = min((3 * size[s] - target[s]) / Fraction(weight[s]) for s in open_)
        level = min(room, left / sum(weight[s] for s in open_))
        for s in open_:
            target[s] += level * weight[s]
        left -= level * sum(weight[s] for s in open_)
        open_ = {s for s in open_ if target[s] < 3 * size[s]}
    return size, target


@pytest.mark.parametrize("seed", [2, 3])
def test_mixture(spark, seed):
    rows = mixture_rows(seed)
    docs = spark.createDataFrame(rows, DOCS)
    once = mixing.decisions(docs).collect()
    assert len(once) == len(rows)
    assert sorted(map(str, once)) == sorted(map(str, mixing.decisions(docs.repartition(7)).collect()))
    size, target = brute_targets(rows)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = dict.fromkeys(size, 0)
    for r in once:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - float(target[s])) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["shards"]) == r["copies"] and all(0 <= x < 16 for x in r["shards"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in size)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    shown = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    copies = {}
    for r in once:
        copies[r["doc_id"], r["size"]] = copies.get((r["doc_id"], r["size"]), 0) + r["copies"]
    got = {}
    for r in sorted(mixed.collect(), key=shown):
        at = (r["doc_id"], len((r["text"] or "").split()))
        got[at] = got.get(at, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    assert mixing.decisions(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_shards_hold_equal_numbers_of_blocks(spark):
    """The shards of a source's draws are the tree's quotas: blocks are dealt in runs, so words are near equal."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 20) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "1 AS copies")
    words = {}
    for r in mixing.decisions(docs, shards=8).collect():
        for s in r["shards"]:
            words[s] = words.get(s, 0) + r["size"]
    assert len(words) == 8 and max(words.values()) < 1.2 * min(words.values())


def test_repeated_rows_reach_the_target(spark):
    """A third of all rows are the same row; they are counted out one by one."""
    rows = [(5, "w " * 30, "b", 1)] * 300 + [(i, "x " * (i % 20), "b" if i % 2 else "a", 1) for i in range(10, 600)]
    size, target = brute_targets(rows)
    once = mixing.decisions(spark.createDataFrame(rows, DOCS)).collect()
    source = {r[0]: r[2] for r in rows}
    for s in size:
        assert abs(sum(r["taken"] for r in once if source[r["doc_id"]] == s) - float(target[s])) <= 30


def test_a_partition_for_each_shard(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20, f"s{i % 5}") for i in range(600)], "doc_id long, text string, source string")
    sizes = [r[0] for r in mixing.mix(docs, shards=16).rdd.mapPartitions(lambda rows: [(sum(1 for _ in rows),)]).collect()]
    assert len(sizes) == 16 and min(sizes) > 0
