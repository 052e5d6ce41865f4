"""The corpus pipeline, stage by stage and whole, and the registered queries against their SQL."""

import math
import os
from hashlib import sha256

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from fieldstream.llm import mixing, queries
from fieldstream.llm.common import written

SF = "/root/testdata/sf0.001"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns and out.count() <= kept.count()
        assert out.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
        kept = out
    assert 0 < kept.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = labels.where("toxic = 1")
    left = corpus_pipeline.toxicity_stage(spark, docs, SF).join(toxic, "doc_id").count()
    assert left <= 0.2 * toxic.count()
    mixed = corpus_pipeline.mixing_stage(spark, kept, SF).cache()
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.decisions(kept).collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and got == {i: n for (i, _), n in copies.items() if n}


def test_last_stage_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).cache()
    ranks = corpus_pipeline.bpe.Bpe(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in corpus_pipeline.tokens_stage(spark, docs, SF).collect():
        ids = plain.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages_one_after_another(spark):
    before = len(written)
    rows = corpus_pipeline.run(spark, SF)
    assert len(written) == before + 1  # nothing stays but what the last stage reads
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))


ODD = [
    (None, "no id here, plain words that say something about the weather of today", None, None, None, "g", "b"),
    (1, None, "en", "a", 0, "g", "b"),
    (2, "", "en", "a", 0, "g", "b"),
    (3, "\u4e2d" * 40_000, "en", None, 40_000, "g", "b"),
    (4, "one", "de", "b", 3, "g", "b"),
    (4, "one", "de", "b", 3, "g", "b"),
    (5, " ".join(f"w{i}" for i in range(60_000)), "fr", "b", 1, "g", "b"),
    (6, " ".join(f"w{i}" for i in range(60_000)), "fr", "c", 1, "g", "b"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, kept string"


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_odd_and_empty_tables(spark, name):
    """Null columns, empty, very long and repeated texts, and columns named like those that stages use."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != NAMES[-1]:
        assert out.columns == docs.columns
    expected = {
        "toxicity": lambda: [r["doc_id"] for r in rows].count(4) == 2 and len(rows) == len(ODD),
        "quality rules": lambda: sorted(r["doc_id"] or 0 for r in rows) == [0, 5, 6],
        "MinHash near-dedup": lambda: sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 4, 5],
        "mixing sources to target weights": lambda: {r["doc_id"] for r in rows} <= {r[0] for r in ODD} and len(rows) > 0,
        "byte-level BPE encoding and decoding": lambda: len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0},
    }
    assert expected[name]()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered(spark):
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    want = sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_return_a_row_a_document(spark, name):
    rows = queries.QUERIES[name](spark, SF).select("doc_id").collect()
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(rows) == sorted(ids)
