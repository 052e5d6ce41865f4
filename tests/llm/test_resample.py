"""Importance resampling against a plain version, and odd rows."""

import math
import random
import re
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from fieldstream.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = WORD.findall(low)
    return ws, [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]


def bucket(gram):
    return crc32(gram.encode()) % 10_000


def plain(docs, target, percent=25):
    raw, aim = {}, {}
    for counts, texts in ((raw, [t for _, t in docs]), (aim, target)):
        for t in texts:
            for g in grams(t)[1]:
                counts[bucket(g)] = counts.get(bucket(g), 0) + 1
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim.get(b, 0) + 1) * (s_all + 10_000) / ((raw.get(b, 0) + 1) * (t_all + 10_000))))
    out = []
    for doc_id, text in docs:
        ws, gs = grams(text)
        weight = math.floor(sum(gain(bucket(g)) for g in gs) / len(gs)) if gs else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(ws)])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def found(spark, docs, target, percent=25):
    df = spark.createDataFrame([(i, t, -1, "w") for i, t in docs], "doc_id long, text string, score int, weight string").repartition(6)
    out = resample.draw(df, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent)
    return [tuple(r) for r in out.select(*COLUMNS).collect()]


def shown(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def words(rng, n):
    return " ".join(rng.choice(["Alpha", "beta-gamma", "é", "ÉCOLE", "x1", "the", "中文", "a,b", " ", "zz"]) for _ in range(n))


def test_against_a_plain_version(spark):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.choice([0, 5, 30, 60]))) for i in range(200)] + [(500, None), (501, ""), (502, "x" * 300_000), (None, words(rng, 40)), (503, words(rng, 20_000))]
    target = [words(rng, 30).replace("the", "alpha") for _ in range(5)] + [None]
    for percent in (25, 100, 0):
        assert shown(found(spark, docs, target, percent)) == shown(plain(docs, target, percent))


def test_ties_and_many_equal_rows(spark):
    text = "one two three four five " * 5
    docs = [(3, text)] * 400 + [(1, text), (2, "other words here " * 10), (4, "short")]
    rows = found(spark, docs, [text], 60)
    assert len(rows) == 403 and sorted(r[4] for r in rows if r[4]) == list(range(1, 60 * 402 // 100 + 1))
    assert shown(rows) == shown(plain(docs, [text], 60))


def test_no_rows_and_no_target(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.draw(empty, empty).count() == 0
    docs = [(i, f"word{i} " * 25) for i in range(8)]
    assert shown(found(spark, docs, [])) == shown(plain(docs, []))


def test_bytes_that_are_no_utf8_are_letters(spark):
    bad = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.expr("cast(x'41ff20e9' AS string)").alias("text"))
    assert resample.draw(bad, bad).first()["n_features"] == 3 and resample.words(b"A\xff \xe9") == [b"a\xff", b"\xe9"]


def test_distinct_scores_stay_below_their_bound():
    noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))) for h in (0, 2**32 - 1)]
    gain = 1000 * math.log(2.0**64 * 2.0**64)
    assert noise[1] - noise[0] + 2 * gain < resample.SCORES_AT_MOST
