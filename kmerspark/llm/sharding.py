"""Contiguous shards of equal byte size from global prefix sums.

Documents in the order of ``doc_id`` are cut where the running byte total passes equal
targets. One range partitioning sorts them; each partition sums as it is read, the totals of
the partitions (one row each) are summed up in order, and a document's prefix is its
partition's offset plus its running sum within. For the numbers alone only identifiers and
sizes are shuffled; ``write_shards`` shuffles the documents once.

A document belongs to the shard in which its first byte falls, so a shard's size differs
from the target by less than one document, whatever a text's length.

Defined results: a null or empty text has 0 bytes and stays with its neighbours; a null
identifier comes before all others. Rows with equal identifiers are taken by size, and
equal rows may stand for one another; many of them are spread over partitions like any
others. An empty table gives an empty result. Where there are fewer documents than shards,
some numbers stay unused. ``assign`` ignores other columns; ``write_shards`` keeps them all,
and adds underscores to the name of its folder column where a column has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerspark.operators.prefix import fresh_name, with_offsets

SHARDS = 64
RANGE_ROWS = 100_000


def _located(rows: DataFrame, doc: Column, size: Column, shards: int, range_rows: int, start: str, shard: str) -> DataFrame:
    """``rows`` with the byte before each in ``start`` and its ``shard``."""
    summed, grand = with_offsets(rows, [doc.asc_nulls_first(), size.asc()], size, start, range_rows)
    whole = fresh_name(summed.columns, "total")
    # the grand total is one row
    target = F.greatest(F.ceil(F.col(whole) / shards), F.lit(1))
    number = F.least(F.floor(F.col(f"`{start}`") / target), F.lit(shards - 1)).cast("int")
    return summed.crossJoin(F.broadcast(grand.toDF(whole))).withColumn(shard, number).drop(whole)


def _bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")


def assign(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, n_bytes, start_byte, shard) for every row."""
    sized = docs.select(F.col("doc_id").cast("bigint"), _bytes().alias("n_bytes"))
    return _located(sized, F.col("doc_id"), F.col("n_bytes"), shards, range_rows, "start_byte", "shard").select("doc_id", "n_bytes", "start_byte", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> str:
    """Write ``docs`` as one folder per shard; the name of the folder column.

    Every row is written once, with all its columns. The files of a folder follow each other
    in the order of ``doc_id``, and so do the rows of a file.
    """
    shard, start = fresh_name(docs.columns, "shard"), fresh_name(docs.columns, "start_byte")
    located = _located(docs, F.col("doc_id"), _bytes(), shards, range_rows, start, shard).drop(start)
    located.write.partitionBy(shard).parquet(path)
    return shard
