"""Quality rules and byte-level BPE against brute force."""

import base64
import random
import time
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldstream.llm import bpe, quality

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
CODER = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


def brute(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e", "line here\nline here\n\nother", "é ü 中文 # $ | <x>", "w " * 300, " ".join(map(str, range(400))), "x" * 50_000, "a b c d e f g h i j k\x1cl"]


def test_counts_equal_brute_force():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    found = quality.measure_texts([None if t is None else t.encode() for t in texts], quality.QualityRules())
    for i, t in enumerate(texts):
        for name, value in brute(t).items():
            assert found[name][i] == value, (t, name)


def test_repetition_is_rejected_and_prose_kept():
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(300))
    looped = "buy this now and save big " * 40
    found = quality.measure_texts([prose.encode(), looped.encode()], quality.QualityRules())
    assert found["kept"].tolist() == [True, False]


def test_measure_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, True), (1, "a b", 5, True), (None, None, None, None)], "doc_id long, text string, n_words int, kept boolean")
    rows = quality.measure(docs).collect()
    assert len(rows) == 3 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert quality.measure(docs.limit(0)).count() == 0 and quality.keep(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None] + ["   leading", "\r\n\r\n", "it's we'll I'd", "1234567890" * 50, "!?" * 333, "aaaa" * 5000, "\U0001f600" * 20])
def test_encoding_equals_library(text):
    ids = CODER.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert CODER.decode(ids) == text.encode()


LONG = {"one letter": "x" * 1_000_000, "two letters": "ab" * 500_000, "digits": "1234567890" * 100_000, "ideographs": "".join(chr(0x4E00 + i * 7919 % 0x5000) for i in range(333_333)), "odd run": "-" * 300_001}


@pytest.mark.parametrize("name", LONG)
def test_long_pieces(name):
    start = time.time()
    ids = bpe.Bpe(RANKS, public_tokenizers.PATTERN).encode(LONG[name])
    assert time.time() - start < 30
    assert ids == PLAIN.encode_ordinary(LONG[name]) and CODER.decode(ids) == LONG[name].encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=6), st.integers(1, 200), st.binary(max_size=6))
def test_merges_agree_on_periodic_bytes(unit, times, end):
    data = unit * times + end
    plain = tuple(PLAIN._encode_single_piece(data))
    assert CODER._merged_by_heap(data) == plain and CODER._merged_at_once(data) in (None, plain) and CODER.encode_bytes(data) == plain


def test_merges_that_overtake():
    """A vocabulary in which a merge makes a pair of lower rank."""
    ranks = [bytes([i]) for i in range(256)] + [b"aba", b"ab"]
    coder = bpe.Bpe(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks)), public_tokenizers.PATTERN)
    assert coder._merged_at_once(b"ab" * 40) is None
    assert coder._merged(b"ab" * 40) == coder._merged_by_heap(b"ab" * 40)
    assert coder.tokens[coder._merged(b"abab")[0]] == b"aba"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_encoding_equals_library_on_any_text(text):
    assert CODER.encode(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(0, 80))
def test_join_is_the_encoding_of_the_whole(data, at):
    at = max(1, min(at, len(data) - 1))
    if at < len(data):
        assert CODER.join(CODER.encode_bytes(data[:at]), CODER.encode_bytes(data[at:])) == CODER.encode_bytes(data)


def test_digests(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert rows[2]["n_tokens"] == 0 and rows[2]["ids_sha256"] == sha256(b"").hexdigest()
    assert rows[1]["decoded_sha256"] == sha256(b"hello world").hexdigest()
    back = bpe.decode(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(bytes(r["data"]) for r in back.collect()) == [b"", b"", b"hello world"]


def test_bpe_of_bytes_that_are_no_utf8(spark):
    from pyspark.sql import functions as F

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(x'61ff62' AS string)").alias("text"))
    row = bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()
    assert row["decoded_sha256"] == sha256("a\ufffdb".encode()).hexdigest()
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert len(encoded.first()["ids"]) == row["n_tokens"]
