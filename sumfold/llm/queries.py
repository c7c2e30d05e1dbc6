"""The corpus operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumfold.llm import decontamination, fingerprints, licenses, line_dedup, merkle, ngram_join, orc_tokens, packing, pii, quality, toxicity, vector_codes, warc_zip
from sumfold.llm.common import scratch, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.default_texts(spark), licenses.default_notices(spark))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.report(warc_zip.read(warc_zip.write(table(spark, sf_dir, "pages"), scratch(spark, "wacz"))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ngram_join.numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ngram_join.groups(docs).select("doc_id", "n_shingles", "component_id")


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = orc_tokens.write(table(spark, sf_dir, "documents"), scratch(spark, "orc_tokens"))
    return orc_tokens.positions(orc_tokens.read(spark, path))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"), merkle.without_newlines_in_half())


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_licenses, op3_warc_zip, op4_quality, op5_packing, op6_fingerprints, op7_toxicity, op8_decontamination, op9_ngram_join, op10_orc_tokens, op11_merkle, op12_pii, op13_vector_codes)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_licenses": licenses.scan_sql(),
    "op11_merkle": merkle.proofs_sql(),
    "op13_vector_codes": vector_codes.compressed_sql(),
    "op3_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM x""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS win
  FROM i, unnest(generate_series(1, greatest(1, len(w) - 12))) AS u(p) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM d, ns, unnest(generate_series(1, len(w) - n + 1)) AS u(p)),
m AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(generate_series(p, p + n - 1)) AS u(q) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)""",
}
