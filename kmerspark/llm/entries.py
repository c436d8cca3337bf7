"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.llm import ann, language_id, mixing, ngram_join, packing, pii, quality, sharding, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_table(spark, sf_dir, "documents"))


def op2_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(_table(spark, sf_dir, "documents"))


def op6_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # record identifiers depend on the files' names, so they are left out of the result
    chunks = warc.pages_to_chunks(_table(spark, sf_dir, "pages")).drop("record_id")
    return chunks.withColumn("payload", F.translate(F.base64("payload"), "\r\n", ""))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), count="replaced")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_byte_sharding": op2_byte_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_repetition_rules": op5_repetition_rules,
    "op6_approximate_neighbours": op6_approximate_neighbours,
    "op7_warc_chunks": op7_warc_chunks,
    "op8_language_id": op8_language_id,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op2_byte_sharding": """
WITH sized AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents),
summed AS (SELECT doc_id, n_bytes, sum(n_bytes) OVER (ORDER BY doc_id, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes AS start_byte, sum(n_bytes) OVER () AS total FROM sized)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(start_byte AS BIGINT) AS start_byte, CAST(least(floor(start_byte / greatest(ceil(total / 64), 1)), 63) AS INTEGER) AS shard FROM summed
""",
    "op3_url_filter": url_filter.ORACLE,
    "op5_repetition_rules": quality.ORACLE,
    "op7_warc_chunks": warc.ORACLE,
    "op10_ngram_jaccard_join": """
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:least(i + 2, len(w))], ' '))) AS g FROM words WHERE len(w) > 0),
sets AS (SELECT doc_id, list_sort(list(DISTINCT g)) AS s FROM grams GROUP BY doc_id),
nodes AS (SELECT min(doc_id) AS d, s, len(s) AS size FROM sets GROUP BY s),
member AS (SELECT doc_id, d FROM sets JOIN nodes USING (s)),
tokens AS (SELECT d, size, unnest(s) AS g FROM nodes),
pairs AS (SELECT a.d AS a, b.d AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS n FROM tokens a JOIN tokens b ON a.g = b.g AND a.d < b.d GROUP BY a.d, b.d),
near AS (SELECT a, b FROM pairs WHERE n / (sa + sb - n) >= 0.4 - 1e-12),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT DISTINCT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a),
class AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
links AS (SELECT a AS x, count(*) AS links FROM both_ways GROUP BY a)
SELECT t.doc_id, coalesce(c.c, m.d, t.doc_id) AS class_id, coalesce(l.links, 0) AS links FROM documents t LEFT JOIN member m ON t.doc_id = m.doc_id LEFT JOIN class c ON m.d = c.x LEFT JOIN links l ON m.d = l.x
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
