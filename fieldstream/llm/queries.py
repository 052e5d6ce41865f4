"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licences, maxent_lm, mixing, near_dup, quality, repair, resample, token_files, topk, toxicity, warc
from .common import shared_dir, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read(spark, path, with_payload=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scored(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc_salvage": op2_warc_salvage,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_minhash_near_dup": op6_minhash_near_dup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_exact_topk": op10_exact_topk,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_files": op12_token_files,
    "op13_importance_resampling": op13_importance_resampling,
}


def _crc_sql(text: str, table: str) -> str:
    """crc32 of a text's UTF-8 bytes by a table of 256 (CRC_TABLE_SQL)."""
    nibble = lambda at: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    step = f"lambda c, i: xor(c >> 8, {table}[(xor(c, 16 * {nibble('2 * i + 1')} + {nibble('2 * i + 2')}) & 255) + 1])"
    return f"xor(4294967295, list_reduce(range(strlen({text})), {step}, 4294967295::BIGINT))"


CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
        c AS (SELECT doc_id, p, word, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY p) AS upto, length(word) AS own FROM w),
        g AS (SELECT d.doc_id, n.n, p.p, array_to_string(d.ws[p.p : p.p + n.n - 1], ' ') AS gram
              FROM d, (SELECT unnest(range(2, 11)) AS n) n, LATERAL (SELECT unnest(range(1, greatest(len(d.ws) - n.n + 2, 1))) AS p) p),
        f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n, gram) AS times, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY p) AS nth FROM g),
        covered AS (SELECT DISTINCT doc_id, n, kind, p + unnest(range(0, n)) AS p FROM (
              SELECT doc_id, n, p, 'later' AS kind FROM f WHERE nth > 1 UNION ALL SELECT doc_id, n, p, 'all' AS kind FROM f WHERE times > 1 AND n = 5)),
        dup AS (SELECT doc_id, n, sum(own) AS bad FROM covered JOIN c USING (doc_id, p) WHERE kind = 'later' AND n >= 5 GROUP BY ALL),
        rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered WHERE kind = 'all' GROUP BY ALL),
        top AS (SELECT f.doc_id, f.n, max(times * (e.upto - b.upto + b.own)) AS bad FROM f JOIN c b ON b.doc_id = f.doc_id AND b.p = f.p JOIN c e ON e.doc_id = f.doc_id AND e.p = f.p + f.n - 1
                WHERE f.n <= 4 AND times > 2 GROUP BY ALL),
        chars AS (SELECT doc_id, sum(own) AS word_chars FROM c GROUP BY ALL),
        bad AS (SELECT doc_id, n, bad, word_chars, 100e0 * bad / word_chars AS share, CASE n WHEN 2 THEN 40 WHEN 3 THEN 36 WHEN 4 THEN 32 WHEN 5 THEN 30 WHEN 6 THEN 28 WHEN 7 THEN 26 WHEN 8 THEN 24 WHEN 9 THEN 22 ELSE 20 END AS most
                FROM (SELECT * FROM dup UNION ALL SELECT * FROM top) JOIN chars USING (doc_id)),
        worst AS (SELECT doc_id, max(share) AS worst_percent, arg_min(n, (-share, n)) AS worst_ngram, bool_or(100 * bad > most * word_chars) AS failed FROM bad GROUP BY ALL),
        lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, t, len(ws) AS n_words FROM d),
        l AS (SELECT doc_id, n_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(list_sum(list_transform(ls, lambda x: strlen(x))), 0) AS all_bytes,
                     coalesce(list_sum(list_transform(list_distinct(ls), lambda x: strlen(x))), 0) AS one_bytes, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM lines),
        r AS (SELECT l.doc_id, n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     100e0 * (all_bytes - one_bytes) / greatest(all_bytes, 1) AS dup_line_percent, CAST(coalesce(worst_ngram, 0) AS INTEGER) AS worst_ngram, coalesce(worst_percent, 0e0) AS worst_percent,
                     coalesce(failed, false) OR 100 * (all_bytes - one_bytes) > 40 * all_bytes AS failed
              FROM l LEFT JOIN chars USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN worst USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               base_failed, dup_line_percent, worst_ngram, worst_percent, NOT base_failed AND NOT failed AS kept FROM b""",
    "op2_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM g""",
    "op6_minhash_near_dup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i : i + 2], ' '))) AS shingle FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
        k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
        FROM documents d JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY ALL) m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_conversation_repair": rf"""
        WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                    {_crc_sql("place", "crc_table")} % 20 AS kind FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations), (SELECT {CRC_TABLE_SQL} AS crc_table)),
        m AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM m),
        f AS (SELECT *, CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                    left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM p),
        moves(a, ini, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins(a, b, cost, audit) AS (SELECT a, a, 0, '' FROM range(4) r(a) UNION ALL VALUES (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
        symbols AS (SELECT DISTINCT ini, fault FROM f),
        own AS (SELECT s.ini, s.fault, r.a, r.a AS b, 4 AS cost, 'D' AS audit FROM symbols s, range(4) r(a)
              UNION ALL SELECT s.ini, s.fault, v.a, v.b, CASE fault WHEN 't' THEN 3 ELSE 0 END + CASE WHEN v.ini = s.ini THEN 0 ELSE 3 END, CASE WHEN v.ini = s.ini THEN 'K' ELSE 'R' END
              FROM symbols s, moves v WHERE fault NOT IN ('b', 'd') AND (v.ini = s.ini OR v.ini <> 's')),
        steps AS (SELECT ini, fault, i.a, o.b AS m, i.cost + o.cost AS cost, i.audit || o.audit AS audit FROM own o JOIN ins i ON i.b = o.a),
        walk(conv_id, pos, state, cost, audit) AS (
              SELECT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM conversations GROUP BY conv_id
              UNION ALL SELECT w.conv_id, w.pos + 1, s.m::BIGINT, min(w.cost + s.cost)::BIGINT, arg_min(w.audit || s.audit, (w.cost + s.cost, w.audit || s.audit))
              FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN steps s ON s.ini = f.ini AND s.fault = f.fault AND s.a = w.state GROUP BY w.conv_id, w.pos, s.m),
        ended AS (SELECT w.*, max(pos) OVER (PARTITION BY conv_id) AS n FROM walk w),
        best AS (SELECT conv_id, min(e.cost + i.cost) AS cost, arg_min(e.audit || i.audit, (e.cost + i.cost, e.audit || i.audit)) AS audit FROM ended e JOIN ins i ON i.a = e.state WHERE e.pos = e.n AND i.b IN (0, 3) GROUP BY conv_id),
        e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS place FROM best WHERE audit <> ''),
        x AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY place) AS pos FROM e),
        y AS (SELECT x.conv_id, x.edit, f.role, CASE WHEN x.edit = 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY x.conv_id ORDER BY place) AS nth FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.pos = x.pos WHERE x.edit <> 'D'),
        z AS (SELECT *, max(CASE WHEN nth = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM y),
        t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth) AS text FROM z GROUP BY conv_id),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(t.text, '')) AS repaired_sha256
        FROM best b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op13_importance_resampling": rf"""
        WITH raw AS (SELECT doc_id, true AS own, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents UNION ALL SELECT item_id, false, row_number() OVER (), coalesce(text, '') FROM benchmark),
        w AS (SELECT own, rid, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
        f AS (SELECT own, rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS gram FROM w),
        g AS (SELECT own, rid, gram, count(*) AS n FROM f GROUP BY ALL),
        c AS (SELECT gram, {_crc_sql("gram", "crc_table")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g), (SELECT {CRC_TABLE_SQL} AS crc_table)),
        b AS (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM g JOIN c USING (gram) GROUP BY ALL),
        a AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM b),
        gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM b, a),
        d AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM g JOIN c USING (gram) JOIN gains USING (bucket) WHERE own GROUP BY rid),
        h AS (SELECT doc_id, rid, list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), i, 1)) - 1), lambda x, y: 16 * x + y, 0::BIGINT) AS h FROM raw WHERE own),
        r AS (SELECT doc_id, rid, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
              FROM h JOIN w USING (rid) LEFT JOIN d USING (rid) WHERE own),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS nth, sum(CASE WHEN n_words >= 20 THEN 1 ELSE 0 END) OVER () AS n FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND nth <= 25 * n // 100 THEN nth END AS rank FROM o""",
}
