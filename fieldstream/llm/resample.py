"""Target-distribution importance resampling by hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is neither letter
nor digit; bytes of other characters stay, so UTF-8 texts are never decoded, and
bytes.split yields the words. An n-gram's bucket is the crc32 of its words joined by
one space: the crc32 of its first words is the seed from which zlib goes on with the
next, for all n-grams of a length in one pass of built-in functions.

Counting: a Counter of each task reduces its texts' buckets to one row a bucket that it has
seen; those rows, at most BUCKETS a task, are all that is shuffled. A bucket's gain is
the floored 1000-fold log ratio of its smoothed shares in the target and in the raw
corpus. BUCKETS gains, a table of fixed size, go to all tasks, which score each
document: the floored mean gain of its n-grams plus Gumbel noise from its id's hash.

Drawing: the highest scores are a weighted sample without replacement. Scores are
whole numbers within a range that does not depend on the data's size (SCORES_AT_MOST),
so a count by score, added up, gives the score at which the sample ends. Only
documents from that score up are dealt by ranges of (score, id) and sorted; a rank is
the place within a range plus the rows of the ranges before, a number a range.

Defined results: a null or empty text has no words, n_features 0, weight 0 and is not
drawn from, but has a score; a null id hashes as the empty text and comes last among
ties; repeated rows are drawn each by itself, adjacent in rank; bytes that are no UTF-8
count as letters; an empty target table leaves all t at 0; an empty corpus gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, settled

BUCKETS = 10_000
#: Distinct scores at most: gains within 1000 * ln(2^64 * 2^64), noise within -3,136 and 22,874.
SCORES_AT_MOST = 205_000
SCORE_SCHEMA = "doc_id long, n_words long, n_features long, weight long, score long"

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: What each byte becomes: lower case, itself, or a blank.
TABLE = bytes(low if (low := b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def buckets(tokens: list[bytes], longest: int = 2, n_buckets: int = BUCKETS) -> list[int]:
    """The bucket of each n-gram of 1 to `longest` words."""
    hashes = seeds = list(map(crc32, tokens))
    spaced = list(map(b" ".__add__, tokens))
    for n in range(1, longest):
        seeds = list(map(crc32, spaced[n:], seeds))
        hashes = hashes + seeds
    return [h % n_buckets for h in hashes]


def counts(rows: DataFrame, text_column: str = "text", longest: int = 2, n_buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for _, texts in byte_slices(batch, "text"):
                for text in texts:
                    total.update(buckets(words(text), longest, n_buckets))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["bucket", "n"])

    return rows.select(F.col(text_column).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], n_buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the counts of the raw corpus and of the target."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + n_buckets) / (float(raw.get(b, 0) + 1) * float(t_all + n_buckets)))) for b in range(n_buckets)]


def noise(doc_id: int | None, seed: int) -> int:
    """1000-fold Gumbel noise, floored, from the hash of seed and id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def fit(docs: DataFrame, target: DataFrame, text_column: str = "text", target_column: str = "text", longest: int = 2, n_buckets: int = BUCKETS) -> list[int]:
    """Gains by bucket; two collects of at most n_buckets numbers each."""
    found = [{r["bucket"]: r["n"] for r in counts(rows, column, longest, n_buckets).collect()} for rows, column in ((docs, text_column), (target, target_column))]
    return gains(*found, n_buckets)


def scored(docs: DataFrame, by_bucket: list[int], seed: int = 7, id_column: str = "doc_id", text_column: str = "text", longest: int = 2) -> DataFrame:
    """One row a document (SCORE_SCHEMA); no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part, texts in byte_slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                out = []
                for doc_id, text in zip(ids, texts, strict=True):
                    tokens = words(text)
                    found = buckets(tokens, longest, len(gain))
                    weight = sum(map(gain.__getitem__, found)) // len(found) if found else 0
                    out.append((len(tokens), len(found), weight, weight + noise(doc_id, seed)))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCORE_SCHEMA)


def _cut(rows: DataFrame, eligible: Column, percent: int) -> tuple[int, int | None]:
    """Documents to draw, and the score of the last of them."""
    by_score = sorted(((r["score"], r["n"]) for r in rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # SCORES_AT_MOST rows
    left = n_drawn = percent * sum(n for _, n in by_score) // 100
    for score, n in by_score:
        left -= n
        if left <= 0 < n_drawn:
            return n_drawn, score
    return 0, None


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score, and its rank where it is drawn."""
    rows = settled(scored(docs, fit(docs, target, text_column, target_column), seed, id_column, text_column))
    eligible = F.col("n_words") >= least_words
    n_drawn, last = _cut(rows, eligible, percent)
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = eligible & (F.col("score") >= last)
    # equal (score, id) have a number of their own, so that many of them do not meet in one range
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("salt"))
    numbered = rows.where(high).withColumn("salt", F.monotonically_increasing_id())
    ranged = settled(numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("salt"))
    span = F.shiftright("at", 33)
    spans = ranged.groupBy(span.alias("span")).agg(F.count("*").alias("n"))
    before = spans.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))  # a row a partition
    ranked = ranged.withColumn("span", span).join(F.broadcast(before), "span")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = ranked.withColumn("rank", F.when(rank <= n_drawn, rank)).select(*rows.columns, "rank")
    return drawn.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))
