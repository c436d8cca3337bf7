"""Reads, mates, templates and primers derived from the text tables.

Each hexadecimal digit of a text's bytes becomes a base (one digit becomes N), the whole
text over. Reads are windows of ``READ_LENGTH`` bases that overlap by k - 1, so that each
k-mer of a text is in exactly one read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerspark.functions.sequences import revcomp
from kmerspark.operators.kmers import _string_buffers, by_size
from kmerspark.operators.prefix import with_offsets

READ_LENGTH, STEP = 150, 132
PRIMER_LENGTH = 18
#: Templates of a graph gene: those whose number has one rest.
GRAPH_GENES = 16
_DIGITS = np.array([4 if digit == 11 else digit & 3 for digit in range(16)], dtype=np.uint16)
#: The two bases of a byte, the first in the lower half.
_PAIRS = (_DIGITS[np.arange(256) >> 4] | _DIGITS[np.arange(256) & 15] << 8).astype("<u2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: str = "text"):
    return F.translate(F.hex(text), "0123456789ABCDEF", "ACGTACGTACGNACGT")


def text_codes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of ``dna`` of texts."""
    body, offsets = _string_buffers(array)
    return _PAIRS[body].view(np.uint8), 2 * offsets


def cut_reads(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``plain_reads`` (doc_id, o, seq) of a batch of (doc_id, seq) with texts, some at a time."""
    for rows in by_size(batch, "seq", 500_000):
        codes, offsets = text_codes(rows.column("seq"))
        long = np.diff(offsets)
        there = rows.column("seq").is_valid().to_numpy(zero_copy_only=False)
        each = np.where(there, np.maximum(long - (READ_LENGTH - STEP + 1), 0) // STEP + 1, 0)
        own = np.repeat(np.arange(len(each)), each)
        o = (np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)) * STEP
        size = np.minimum(long[own] - o, READ_LENGTH)
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[own] + o - (ends - size), size)
        body = np.frombuffer(b"ACGTN", np.uint8)[codes[at]]
        seq = pa.StringArray.from_buffers(len(own), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(own)), pa.array(o.astype(np.int32)), seq], names=["doc_id", "o", "seq"])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, seq): the texts, of which ``text_codes`` makes the bases of all reads.

    Reads hold each k-mer of a text once, so the k-mers of texts and of their reads are the same.
    """
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("seq"))


def windows(frame: DataFrame) -> DataFrame:
    """One row per window of ``dna``: ``o`` is its start, ``seq`` its bases."""
    last = F.greatest(F.length("dna") - (READ_LENGTH - STEP + 1), F.lit(0))
    return frame.withColumn("o", F.explode(F.sequence(F.lit(0), last, F.lit(STEP)))).withColumn("seq", F.substring("dna", F.col("o") + 1, F.lit(READ_LENGTH)))


def numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, first): the documents with the number of their first read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # two bases a byte
    count = F.floor(F.greatest(2 * F.octet_length("text") - (READ_LENGTH - STEP + 1), F.lit(0)) / STEP) + 1
    return with_offsets(docs, [F.col("doc_id").asc()], count, "first", 2_000)[0]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, source, doc_id, seq): all documents as reads, numbered in order."""
    numbered = numbered_texts(spark, sf_dir)
    cut = windows(numbered.select("doc_id", "source", "first", dna().alias("dna")))
    return cut.select((F.col("first") + F.col("o") / STEP).cast("bigint").alias("read_id"), "source", "doc_id", "seq")


def chunk_groups(chunks: int, batch: int):
    """Groups of ``tally.counted`` for ``numbered_texts``: the chunk of each window's read."""

    def groups(part: pa.RecordBatch, row: np.ndarray, position: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        read = part.column("first").to_numpy()[row] + position // STEP
        return [(i,) for i in range(chunks)], read // batch % chunks

    return groups


def plain_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, o, source, seq): the reads without numbers, for operators that need none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", dna().alias("dna"))
    return windows(docs).select("doc_id", "o", "source", "seq")


def mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """R1 (questions) and R2 (answers) of the conversations: (i, seq), numbered from 0."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", dna().alias("seq"))
    keyed = talk.withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn"))
    sides = []
    for side in (0, 1):
        one = keyed.where(F.col("turn") % 2 == side)
        sides.append(with_offsets(one, [F.col("key").asc()], F.lit(1), "i")[0].select("i", "seq"))
    return sides[0], sides[1]


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, dna) of the benchmark passages that have room for two primers."""
    return table(spark, sf_dir, "benchmark").select("item_id", dna().alias("dna")).where(F.length("dna") >= 2 * PRIMER_LENGTH)


def primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, forward_seq, reverse_seq, max_length): primers at both ends of each template.

    The fifth base of each primer is widened to the ambiguity code of its kind (R or Y).
    """
    def widen(seq):
        return F.concat(F.substring(seq, 1, 4), F.translate(F.substring(seq, 5, 1), "ACGTN", "RYRYN"), F.substring(seq, 6, PRIMER_LENGTH - 5))

    rows = templates(spark, sf_dir).select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("gene"), F.substring("dna", 1, PRIMER_LENGTH).alias("f"), revcomp(F.substring("dna", -PRIMER_LENGTH, PRIMER_LENGTH)).alias("r"), (2 * F.length("dna")).alias("most"))
    return rows.select("gene", widen(F.col("f")).alias("forward_seq"), widen(F.col("r")).alias("reverse_seq"), F.col("most").alias("max_length"))


def numbered_by(frame: DataFrame, *order: str) -> DataFrame:
    """Row numbers of a small table."""
    return frame.withColumn("row", F.row_number().over(Window.orderBy(*order)) - 1)
