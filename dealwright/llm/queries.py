"""Queries that apply the operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealwright.llm import (
    ann,
    bpe,
    codes,
    grid_join,
    html_text,
    importance,
    langid,
    mixing,
    ppm,
    quality,
    simhash,
    suffixes,
    warc,
)
from dealwright.llm.common import table
from dealwright.session import fresh_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50; all rows are indexed."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where(F.col("vec_id") % 50 == 0), ann.index(vectors), k=5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_near_vectors": op5_near_vectors,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
    "op11_vector_codes": op11_vector_codes,
    "op12_lm_scores": op12_lm_scores,
    "op13_resampling": op13_resampling,
}


def _lloyd_round_sql(k: int) -> str:
    """The nearest entry of round ``k`` for every part, and the codebooks of the next round."""
    return f"""
found{k} AS MATERIALIZED (
  SELECT p.vec, p.part, arg_min(e.entry, e.distance * 64 + e.entry) AS entry, min(e.distance) AS distance
  FROM parts p, LATERAL (
    SELECT b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM books{k} b WHERE b.part = p.part) e
  GROUP BY p.vec, p.part
),
sums{k} AS (
  SELECT part, entry, j, sum(p.x[j])::BIGINT AS s, count(*) AS n
  FROM found{k} JOIN parts p USING (vec, part), range(1, 5) AS r(j) GROUP BY part, entry, j
),
books{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books{k} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM sums{k} GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry
),"""


#: Queries whose rows SQL can express.
CHECKS: dict[str, str] = {
    "op5_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u),
firsts AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN firsts f ON f.u = e.vec_id
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
""",
    "op11_vector_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS vec, vec_id, label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec, part, v[4 * part + 1 : 4 * part + 4] AS x FROM kept, range(16) AS r(part)),
books0 AS MATERIALIZED (SELECT part, vec - 1 AS entry, x FROM parts WHERE vec <= 64),
{"".join(_lloyd_round_sql(k) for k in range(3))}
coded AS (
  SELECT vec, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
  FROM found2 GROUP BY vec
),
label_errors AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec) GROUP BY label),
books AS (
  SELECT sha256(string_agg(x[j]::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256
  FROM books2, range(1, 5) AS r(j)
)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN kept k USING (vec) JOIN label_errors l ON l.label IS NOT DISTINCT FROM k.label, books
""",
    "op13_resampling": r"""
WITH steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
texts AS (
  SELECT 'd' AS part, row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
),
split AS MATERIALIZED (
  SELECT part, id, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
),
words AS (SELECT part, id, unnest(words) AS word FROM split),
per_word AS MATERIALIZED (SELECT part, id, word, count(*) AS n FROM words GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_concat([4294967295], list_transform(range(strlen(word)),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM per_word), steps
),
per_bucket AS (
  SELECT bucket, sum(CASE part WHEN 'd' THEN n ELSE 0 END) AS s, sum(CASE part WHEN 'b' THEN n ELSE 0 END) AS t
  FROM per_word JOIN buckets USING (word) GROUP BY bucket
),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM per_bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(
    ((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM per_bucket, totals
),
weights AS (
  SELECT id, sum(n * gain)::BIGINT AS weight FROM per_word JOIN buckets USING (word) JOIN gains USING (bucket)
  WHERE part = 'd' GROUP BY id
),
scored AS (
  SELECT s.id, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT)::BIGINT AS score
  FROM split s LEFT JOIN weights w ON s.id = w.id WHERE part = 'd'
),
ranked AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked r ON s.id = r.id
""",
}
