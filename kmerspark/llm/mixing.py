"""Mixing sources to target weights by pivotal dependent rounding.

A source whose share of the corpus (in characters) is to become ``w`` needs each of its
documents ``epochs = w * total / size`` times. The whole part of that is given to every
document; the fraction is rounded by the pivotal method: two fractions of one source meet,
mass moves at random from one to the other until one of them is 0 or 1, and the other goes
on to the next pair. Every document's expected copies are its epochs, and the number of
copies of each source is its exact sum of epochs, up or down to a whole number.

Documents are spread over buckets by a hash; a bucket settles all but one fraction of each
source, and the residual fractions are paired again along a tree of ``FAN_IN`` buckets a
node until one is left, which is rounded by chance. Fractions are whole multiples of 2**-40,
so that no mass is lost by rounding. All chance comes from hashes of the seed, so a task
that is run again decides alike.

Target weights default to shares proportional to ``size ** alpha`` (temperature sampling);
a table of weights (source, weight) may be given instead.

Defined results: a unit is a distinct (doc_id, source); rows that repeat one are copied
together. A null source is a source, a null identifier an identifier. Null or negative
``n_chars`` counts as 0. Sources without weight or with no characters get the copies they
have (epochs 1) if no weights are given, none otherwise; weights of absent sources are
ignored, and negative or null ones count as 0. An empty table gives an empty result. Texts are
never looked at, so their length does not matter. Equal ties go by the order of the hash.
Other columns are ignored by ``copies`` and kept by ``mix_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerspark.llm.text import U64, mix
from kmerspark.session import checkpointed

ALPHA = 0.7
ONE = 1 << 40
BUCKET_ROWS = 50_000
FAN_IN = 64
#: Up to so many decisions, they are broadcast instead of shuffling the documents.
BROADCAST_UNITS = 500_000


def pivot(group: np.ndarray, mass: np.ndarray, tie: np.ndarray, seed: int) -> np.ndarray:
    """Move mass within each group until at most one entry of it is fractional.

    ``mass`` counts units of 2**-40 from 0 to 2**40. Pairs are neighbours by (group, tie);
    all pairs of a round are settled at once, and the survivors pair again.
    """
    mass = mass.copy()
    order = np.lexsort((tie, group))
    live = order[(mass[order] > 0) & (mass[order] < ONE)]
    turn = 0
    while len(live) > 1:
        g = group[live]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        rank = np.arange(len(live)) - np.repeat(start, np.diff(np.append(start, len(live))))
        first = np.flatnonzero((rank % 2 == 0) & np.append(g[1:] == g[:-1], False))
        if not len(first):
            break
        i, j = live[first], live[first + 1]
        a, b = mass[i], mass[j]
        with np.errstate(over="ignore"):
            chance = mix(mix(tie[i].astype(np.int64).view(U64) + U64(seed)) ^ mix(tie[j].astype(np.int64).view(U64) + U64(turn + 1)))
        u = (chance >> U64(11)).astype(np.float64) / (1 << 53)
        total = a + b
        under = total < ONE
        # below one: all mass to one of the two; else one of the two becomes whole
        wins = u < np.where(under, a / total, (ONE - b) / np.maximum(2 * ONE - total, 1))
        mass[i] = np.where(wins, np.minimum(total, ONE), np.maximum(total - ONE, 0))
        mass[j] = total - mass[i]
        live = live[(mass[live] > 0) & (mass[live] < ONE)]
        turn += 1
    return mass


def epochs_by_source(docs: DataFrame, weights: DataFrame | None, alpha: float) -> DataFrame:
    """(source, units, size, epochs): how often each source is to be seen."""
    size = F.coalesce(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
    totals = docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum(size).alias("size"))
    if weights is None:
        wanted = totals.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(alpha))).otherwise(0.0))
    else:
        given = weights.select(F.col("source").alias("_source"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_weight")).groupBy("_source").agg(F.sum("_weight").alias("weight"))
        wanted = totals.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("weight", F.when(F.col("size") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    whole = wanted.agg(F.sum("size").alias("_size"), F.sum("weight").alias("_weight"))
    share = F.col("weight") / F.col("_weight") * F.col("_size") / F.col("size")
    other = 1.0 if weights is None else 0.0
    epochs = F.when((F.col("size") > 0) & (F.col("_weight") > 0), share).otherwise(F.lit(other))
    return wanted.crossJoin(whole).select("source", "rows", "size", "weight", epochs.alias("epochs"))


def _settle(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Pivot within the groups of a partition that is sorted by ``bucket``."""
    held: list[pa.RecordBatch] = []

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names, codes = table["source"].combine_chunks(), None
        codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        bucket = table["bucket"].to_numpy()
        groups = np.unique(np.stack([bucket, codes]), axis=1, return_inverse=True)[1].ravel()
        mass = pivot(groups, table["mass"].to_numpy(), table["tie"].to_numpy(), seed)
        yield from table.set_column(table.schema.get_field_index("mass"), "mass", pa.array(mass)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        bucket = batch.column("bucket").to_numpy()
        last = int(np.searchsorted(bucket, bucket[-1]))
        if held[0].column("bucket")[0].as_py() != bucket[-1]:
            done = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
            yield from emit(done)
    if held:
        yield from emit(pa.Table.from_batches(held))


def copies(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, seed: int = 17) -> DataFrame:
    """(doc_id, source, copies): one row per distinct document of each source."""
    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "n_chars")
    targets = checkpointed(epochs_by_source(columns, weights, alpha)).select(F.col("source").alias("_source"), "epochs", "rows")
    rows = targets.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET_ROWS))
    units = columns.select("doc_id", "source").distinct()
    tie = F.xxhash64("doc_id", "source", F.lit(seed))
    whole = F.floor("epochs")
    placed = (
        units.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", whole.cast("bigint").alias("base"), F.round((F.col("epochs") - whole) * ONE).cast("bigint").alias("mass"), tie.alias("tie"))
        .withColumn("bucket", F.pmod(F.xxhash64("tie"), F.lit(buckets)))
    )
    schema = placed.schema

    def level(frame: DataFrame, number: int) -> DataFrame:
        grouped = frame.repartition("bucket").sortWithinPartitions("bucket")
        return grouped.mapInArrow(lambda batches: _settle(batches, seed + 1000 * number), schema)

    settled = checkpointed(level(placed, 0))
    fraction = (F.col("mass") > 0) & (F.col("mass") < ONE)
    done = settled.where(~fraction)
    residual, number = settled.where(fraction), 0
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        number += 1
        merged = checkpointed(level(residual.withColumn("bucket", F.pmod(F.col("bucket"), F.lit(buckets))), number))
        done = done.unionByName(merged.where(~fraction))
        residual = merged.where(fraction)
    # the one fraction left of each source
    chance = F.pmod(F.xxhash64("tie", F.lit(seed + 1)), F.lit(ONE))
    last = residual.withColumn("mass", F.when(chance < F.col("mass"), F.lit(ONE)).otherwise(F.lit(0)))
    return done.unionByName(last).select("doc_id", "source", (F.col("base") + (F.col("mass") >= ONE).cast("bigint")).alias("copies"))


def mix_documents(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as its copies say; all columns as they are."""
    # names that no column of docs has
    tag = "_"
    while any(c.lower().startswith(f"{tag}mix_") for c in docs.columns):
        tag += "_"
    key, own, source, times, copy = (f"{tag}mix_{x}" for x in ("key", "id", "source", "times", "copy"))
    decided = checkpointed(copies(docs, weights, alpha, seed).where("copies > 0").toDF(own, source, times))
    # texts stay where they are while the decisions (about 50 bytes each) are few enough to go to them
    if decided.count() <= BROADCAST_UNITS:
        decided = F.broadcast(decided)
    # a plain equality drives the join; null identifiers meet under a substitute key
    meet = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**63)))
    joined = docs.withColumn(key, meet("doc_id")).join(decided.withColumn(key, meet(own)), key)
    exact = joined.where(F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)) & F.col("source").cast("string").eqNullSafe(F.col(source)))
    return exact.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def weights_frame(spark, weights: dict[str | None, float]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"source": list(weights), "weight": [float(v) for v in weights.values()]}), "source string, weight double")
