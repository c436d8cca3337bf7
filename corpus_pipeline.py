"""The corpus pipeline: raw documents in, a packing plan of the training mixture out.

Each stage gets what the stage before it kept, written as Parquet and read again. All but
the last return the columns of ``documents``; the last one places every document kept (as
often as the mixture repeats it) into bins: (bin, slot, doc_id, start, length).

Nulls, empty texts, repeated rows and empty tables are defined by the operators the stages
call; in short: a document without letters or text goes at the first stage, a document
without an identifier is never taken for a copy, and no stage changes other columns than
``lang`` (as identified), ``text`` (surrogates) and ``n_chars`` (kept in step).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerspark.llm import language_id, mixing, ngram_join, packing, pii
from kmerspark.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, ``lang`` as identified; rejected ones go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies, the one with the least doc_id."""
    return ngram_join.one_of_each(docs)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keyed surrogates in place of personal data and secrets."""
    return pii.replace_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights."""
    return mixing.mix_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin, and a place in it, for every piece of every document."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii_surrogates", replace_private_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]

#: SQL cannot express hashed n-gram centroids, keyed surrogates or pivotal rounding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; stage tables go to the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
