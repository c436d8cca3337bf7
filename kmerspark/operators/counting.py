"""K-mer counts as a table (kmer BIGINT, n BIGINT), and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerspark.functions.sequences import COUNT_LIMIT, saturated, valid_bases
from kmerspark.operators import tally
from kmerspark.operators.kmers import DEFAULT_K


def count_kmers(reads: DataFrame, k: int = DEFAULT_K, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, kmer, n): canonical k-mer counts, held at 2**32 - 1."""
    types = dict(reads.dtypes)
    return tally.counted(reads.select(*keys, "seq"), k, ", ".join(f"{c} {types[c]}" for c in keys), tally.column_groups(keys) if keys else None)


def merge_counts(*tables: DataFrame) -> DataFrame:
    """The sum of several count tables of the same k."""
    merged = tables[0].select("kmer", "n")
    for other in tables[1:]:
        merged = merged.unionByName(other.select("kmer", "n"))
    return merged.groupBy("kmer").agg(saturated(F.sum("n")).alias("n"))


def at_least(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("n") >= least)


def lookup(counts: DataFrame, wanted: DataFrame, least: int = 0) -> DataFrame:
    """``wanted`` (kmer, canonical) with its count; 0 where it is absent or below ``least``."""
    known = at_least(counts, least).select(F.col("kmer").alias("_kmer"), F.col("n").alias("_n"))
    return wanted.join(known, F.col("kmer") == F.col("_kmer"), "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_kmer", "_n")


def summary(counts: DataFrame) -> DataFrame:
    """One row: totals, distinct, singleton and multiple k-mers, and the largest count."""
    single = F.coalesce(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(total.alias("n_kmers"), F.count("*").alias("n_unique"), F.coalesce(F.max("n"), F.lit(0)).alias("max_count"), single.alias("n_singletons"), F.greatest(total - single, F.lit(0)).alias("n_multi"))


def frequencies(counts: DataFrame) -> DataFrame:
    """(n, f): how many k-mers have each count; small, whatever the number of k-mers."""
    return counts.groupBy("n").agg(F.count("*").alias("f"))


def _at_rank(freq: DataFrame, rank: Column, total: str = "_total") -> Column:
    return F.min(F.when(F.col("_upto") >= rank, F.col("n")))


def integer_median(counts: DataFrame) -> DataFrame:
    """(median): with an even number, both middle counts are halved and floored first.

    Ranks come from the running total over the frequencies of counts, not from sorting k-mers.
    """
    freq = frequencies(counts)
    running = freq.withColumn("_upto", F.sum("f").over(Window.orderBy("n"))).crossJoin(freq.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("_total")))
    low = _at_rank(running, F.floor((F.col("_total") + 1) / 2))
    high = _at_rank(running, F.floor(F.col("_total") / 2) + 1)
    whole = running.agg(low.alias("low"), high.alias("high"), F.max("_total").alias("total"))
    odd = F.col("total") % 2 == 1
    return whole.select(F.coalesce(F.when(odd, F.col("low")).otherwise(F.floor(F.col("low") / 2) + F.floor(F.col("high") / 2)), F.lit(0)).cast("bigint").alias("median"))


def exact_median(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """(*keys, median): the mean of the middle two where their number is even; 0 for none."""
    return values.groupBy(*keys).agg(F.coalesce(F.percentile(column, F.lit(0.5)), F.lit(0.0)).alias("median"))


def mean_or_zero(column: str) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def variation(column: str) -> Column:
    """Population coefficient of variation; 0 where the mean is 0."""
    mean = F.avg(column)
    return F.coalesce(F.when(mean == 0, F.lit(0.0)).otherwise(F.stddev_pop(column) / mean), F.lit(0.0))


def run_totals(reads: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """(n_reads, n_bases, n_subreads, n_valid_bases): a read counts once however N splits it."""
    return reads.agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"), F.count("*").alias("n_subreads"), F.sum(valid_bases("seq")).alias("n_valid_bases"))


def check_totals(counts: DataFrame, histogram: DataFrame, ingested: int) -> None:
    """Raise if counts, histogram and ingested k-mers disagree (saturated counts aside)."""
    held, distinct, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    bins = histogram.agg(F.coalesce(F.sum("n_kmers"), F.lit(0))).first()[0]
    if most < COUNT_LIMIT and held != ingested:
        raise ValueError(f"counts hold {held} k-mers, {ingested} were ingested")
    if bins != distinct:
        raise ValueError(f"the histogram holds {bins} distinct k-mers, the counts {distinct}")
