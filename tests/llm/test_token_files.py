"""Token-id files: the perfect hash, round trips against the library, keyed access, odd rows."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldstream.llm import token_files
from fieldstream.llm.common import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    ids = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    ids, nth = np.concatenate([ids, np.full(n // 3, 7)]), np.concatenate([np.zeros(len(ids), np.int64), np.arange(n // 3)])
    made = token_files.PerfectHash.of(ids, nth)
    again = token_files.PerfectHash.from_bytes(made.to_bytes())
    assert sorted(again.slots(ids, nth).tolist()) == list(range(len(ids)))
    if n > 1:
        assert len(made.to_bytes()) * 8 / len(ids) < 10 or n < 1000


def test_keys_left_over_are_found(monkeypatch):
    monkeypatch.setattr(token_files, "LEVELS", 1)
    ids, nth = np.arange(5000), np.zeros(5000, np.int64)
    made = token_files.PerfectHash.from_bytes(token_files.PerfectHash.of(ids, nth).to_bytes())
    assert len(made.left) > 100 and sorted(made.slots(ids, nth).tolist()) == list(range(5000))
    assert made.slots(np.array([9999]), np.array([3]))[0] in range(-1, 5000)


ODD = ["", " ", "  two  blanks ", "a\n b", "a \n  b\n\n c", "\xa0x 　y ᠎z ​w", "don't we'll  I'm", "x" * 30_000, "😀 é 中文 ok, 12 3.4", "<|endoftext|> end", "\x1c a \x85 b", "tab\t tab \tt", ". , .,", " lead", "trail "]


def test_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    encoder = token_files.Encoder(library.to_str())
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "b ", " ", "\n", "é", ".", ", ", "1", "'s", " ", "中"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for start in range(0, len(texts), 50):
        run = texts[start : start + 50]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(run)] == [library.encode(t, add_special_tokens=False).ids for t in run]


def wanted(library, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_round_trip(spark, library, block, monkeypatch):
    monkeypatch.setattr(token_files, "PART_KEYS", 64)
    rng = random.Random(1)
    rows = [(i * 3 - 100, rng.choice([*ODD, None, f"word{i} again"]), i) for i in range(300)]
    df = spark.createDataFrame([(i, t, n, "y") for i, t, n in rows], "doc_id long, text string, ids int, shard string").repartition(5)
    got = token_files.round_trip(df, path := shared_dir(spark), VOCABULARY, block_bytes=block)
    assert sorted(map(tuple, got.collect())) == sorted(wanted(library, sorted((i, t) for i, t, _ in rows)))
    assert (spark.read.format("binaryFile").load(f"{path}/ids").count() > 10) is (block == 64)


def test_repeated_and_missing_ids(spark, library):
    rows = [(None, "none one"), (None, "none two"), (5, "b"), *[(7, "same text")] * 200, (7, "other"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = token_files.round_trip(df, path := shared_dir(spark), VOCABULARY).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((i or -1, size(t)) for i, t in rows)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *[r["n_tokens"] for r in by_start]])[:-1].tolist()
    assert [r["doc_id"] for r in by_start] == [None, None, 5, *[7] * 201, 9]
    keys = spark.createDataFrame([(7, n) for n in (0, 100, 200, 201)] + [(5, 0), (5, 1), (6, 0), (None, 0)], "doc_id long, nth long")
    found = token_files.fetch(spark, f"{path}/ids", f"{path}/index", keys).collect()
    assert sorted((r["doc_id"], r["nth"]) for r in found) == [(5, 0), (7, 0), (7, 100), (7, 200)]
    assert all(crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in found)
    five = next(r for r in found if r["doc_id"] == 5)
    assert np.frombuffer(five["ids"], "<u4").tolist() == [*library.encode("b", add_special_tokens=False).ids, 2]


def test_empty_table_and_bad_bytes(spark, library):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = shared_dir(spark)
    assert token_files.round_trip(empty, path, VOCABULARY).count() == 0
    assert token_files.lookup(spark, f"{path}/index", spark.createDataFrame([(1, 0)], "doc_id long, nth long")).count() == 0
    bad = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.expr("cast(x'61ff62' AS string)").alias("text"))
    row = token_files.round_trip(bad, shared_dir(spark), VOCABULARY).first()
    assert tuple(row) == wanted(library, [(1, "a�b")])[0]


def test_broken_file_is_told():
    with pytest.raises(ValueError, match="no block"):
        list(token_files.documents_of(memoryview(b"\nIDBLOCK2" + bytes(100)), False))
