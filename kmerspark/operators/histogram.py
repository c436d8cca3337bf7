"""Histograms of k-mer counts: one, or one for each prefix of the chunks of reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerspark.session import checkpointed

MAX_COUNT = 10_000


def histogram(counts: DataFrame, most: int = MAX_COUNT) -> DataFrame:
    """(count, n_kmers) of the counts that occur; ``most`` + 1 stands for all larger ones."""
    return counts.groupBy(F.least("n", F.lit(most + 1)).alias("count")).agg(F.count("*").alias("n_kmers"))


def dense(found: DataFrame, most: int = MAX_COUNT) -> DataFrame:
    """A histogram with a row for every count from 1 to ``most`` + 1."""
    spark = found.sparkSession
    bins = spark.range(1, most + 2).select(F.col("id").alias("count"))
    return bins.join(found, "count", "left").select("count", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"))


def totals(counts: DataFrame) -> DataFrame:
    """(n_kmers, n_unique) from the frequencies of exact counts."""
    freq = counts.groupBy("n").agg(F.count("*").alias("f"))
    return freq.agg(F.coalesce(F.sum(F.col("n") * F.col("f")), F.lit(0)).alias("n_kmers"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_unique"))


def moves(chunk_counts: DataFrame, most: int = MAX_COUNT) -> DataFrame:
    """(chunk, count, delta): how the histogram changes as each chunk is added.

    A k-mer that a chunk holds leaves the bin of its count so far for that of its new one.
    """
    order = Window.partitionBy("kmer").orderBy("chunk")
    upto = chunk_counts.withColumn("new", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = upto.select("chunk", F.least("new", F.lit(most + 1)).alias("new"), F.least(F.col("new") - F.col("n"), F.lit(most + 1)).alias("old"))
    both = F.explode(F.array(F.struct(F.col("new").alias("count"), F.lit(1).alias("d")), F.struct(F.col("old").alias("count"), F.lit(-1).alias("d")))).alias("m")
    moved = steps.where("old <> new").select("chunk", both).where("m.count > 0")
    return moved.groupBy("chunk", F.col("m.count").alias("count")).agg(F.sum("m.d").alias("delta"))


def found_moves(found: dict, most: int = MAX_COUNT) -> Iterator[pa.RecordBatch]:
    """``moves`` of what a task of ``tally.counted`` has found for the groups (chunk,), to be summed."""
    if not found:
        return
    groups = sorted(found)
    numbers, n = (np.concatenate([found[g][i] for g in groups]) for i in (0, 1))
    chunk = np.repeat(np.array([g[0] for g in groups], dtype=np.int64), [len(found[g][0]) for g in groups])
    # chunks stay in their order within a k-mer
    order = np.argsort(numbers, kind="stable")
    numbers, n, chunk = numbers[order], n[order], chunk[order]
    upto = np.cumsum(n)
    first = np.append(True, numbers[1:] != numbers[:-1])
    new = upto - np.maximum.accumulate(np.where(first, upto - n, 0))
    old = np.minimum(new - n, most + 1)
    new = np.minimum(new, most + 1)
    moved = old != new
    chunk, new, old = chunk[moved], new[moved], old[moved]
    left = old > 0
    bins, at = np.unique(np.append(chunk, chunk[left]) * (most + 2) + np.append(new, old[left]), return_inverse=True)
    delta = np.bincount(at, weights=np.append(np.ones(len(new)), -np.ones(np.count_nonzero(left)))).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array((bins // (most + 2)).astype(np.int32)), pa.array(bins % (most + 2)), pa.array(delta)], names=["chunk", "count", "delta"])


def cumulative(chunk_counts: DataFrame, chunks: int, most: int = MAX_COUNT) -> DataFrame:
    """(chunk, count, n_kmers) after each chunk, for every count that ever occurs."""
    return accumulated(moves(chunk_counts, most), chunks)


def accumulated(delta: DataFrame, chunks: int) -> DataFrame:
    """``cumulative`` from ``moves``, which are at most chunks x bins rows; they are read twice, so written down."""
    delta = checkpointed(delta)
    spark = delta.sparkSession
    grid = delta.select("count").distinct().crossJoin(spark.range(chunks).select(F.col("id").cast("int").alias("chunk")))
    filled = grid.join(delta, ["chunk", "count"], "left").withColumn("delta", F.coalesce("delta", F.lit(0)))
    running = Window.partitionBy("count").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("chunk", "count", F.sum("delta").over(running).alias("n_kmers"))


def wide(cumulated: DataFrame, chunks: int) -> DataFrame:
    """(count, chunk_1, ..., chunk_n)."""
    pivoted = cumulated.groupBy("count").pivot("chunk", list(range(chunks))).agg(F.first("n_kmers"))
    return pivoted.select("count", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"chunk_{i + 1}") for i in range(chunks)])


def long(wide_table: DataFrame, chunks: int) -> DataFrame:
    """The columns of a wide histogram as rows (chunk, count, n_kmers)."""
    pairs = ", ".join(f"{i}, chunk_{i + 1}" for i in range(chunks))
    return wide_table.selectExpr("count", f"stack({chunks}, {pairs}) AS (chunk, n_kmers)")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(count, left_kmers, right_kmers) of the counts in which two histograms differ."""
    right = b.select(F.col("count").alias("_count"), F.col("n_kmers").alias("_n"))
    both = a.join(right, F.col("count") == F.col("_count"), "full")
    rows = both.select(F.coalesce("count", "_count").alias("count"), F.coalesce("n_kmers", F.lit(0)).alias("left_kmers"), F.coalesce("_n", F.lit(0)).alias("right_kmers"))
    return rows.where("left_kmers <> right_kmers")
