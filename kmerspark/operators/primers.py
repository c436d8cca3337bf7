"""Primer pairs: checks, expansion to oligos, matching to k-mers, and what follows from it.

All pairs are handled in one job; a pair is a row of (gene, forward_seq, reverse_seq, ...).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerspark.functions.sequences import IUPAC, decode, encode, is_iupac, revcomp
from kmerspark.operators import tally
from kmerspark.session import checkpointed

DEFAULTS = {"min_length": 0, "max_length": 10_000, "min_count": 2, "mismatches": 2, "trim": 15, "dedup_edit_threshold": 10}
MOST_VARIANTS, MOST_KMERS = 10_000, 40
BROADCAST_OLIGOS = 2_000_000
STEPS, MULTIPLIER = 4, 2
BUDGET_LOW, BUDGET_HIGH, BASES_LOW, BASES_HIGH = 100_000, 500_000, 150_000_000, 750_000_000


def with_defaults(pairs: DataFrame) -> DataFrame:
    for name, value in DEFAULTS.items():
        given = F.coalesce(F.col(name), F.lit(value)) if name in pairs.columns else F.lit(value)
        pairs = pairs.withColumn(name, given.cast("int"))
    return pairs


def errors(pairs: DataFrame) -> DataFrame:
    """(gene, errors): the rules that each pair breaks, in order."""

    def rule(broken: Column, text: str) -> Column:
        return F.when(broken, F.lit(text))

    f, r = F.col("forward_seq"), F.col("reverse_seq")
    rules = [
        rule(F.length(f) < 2, "forward too short"),
        rule(F.length(r) < 2, "reverse too short"),
        rule((F.length(f) >= 2) & ~is_iupac(f), "forward has invalid bases"),
        rule((F.length(r) >= 2) & ~is_iupac(r), "reverse has invalid bases"),
        rule(F.col("min_length") > F.col("max_length"), "min_length over max_length"),
        rule(F.col("min_count") < 2, "min_count below 2"),
        rule(F.col("max_length") == 0, "max_length is 0"),
        rule(F.coalesce(F.col("gene"), F.lit("")) == "", "no gene name"),
        rule((f == r) & (F.length(f) >= 2), "primers are identical"),
    ]
    return with_defaults(pairs).select("gene", F.filter(F.array(*rules), lambda x: x.isNotNull()).alias("errors"))


def sides(pairs: DataFrame, k: int) -> DataFrame:
    """(gene, dir, primer, mismatches, min_count): both primers, their last ``trim`` bases (k-1 at most)."""
    pairs = with_defaults(pairs)
    kept = F.least(F.col("trim"), F.lit(k - 1))
    each = F.explode(F.array(F.struct(F.lit("fwd").alias("dir"), F.col("forward_seq").alias("seq")), F.struct(F.lit("rev").alias("dir"), F.col("reverse_seq").alias("seq")))).alias("s")
    return pairs.select("gene", each, kept.alias("kept"), "mismatches", "min_count").select("gene", "s.dir", F.expr("right(s.seq, kept)").alias("primer"), "mismatches", "min_count")


def expand(primer: Column) -> Column:
    """All plain sequences that a primer with ambiguity codes stands for."""
    table = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, bases)])
    chars = F.filter(F.split(primer, ""), lambda c: c != "")
    grown = lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(F.filter(F.split(table[c], ""), lambda b: b != ""), lambda b: F.concat(a, b))))
    return F.aggregate(chars, F.array(F.lit("")), grown)


def oligos(pairs: DataFrame, k: int, mismatches: int | None = None) -> DataFrame:
    """(gene, dir, level, oligo, min_count): level m holds what m substitutions reach, and no fewer."""
    base = sides(pairs, k)
    if mismatches is not None:
        base = base.withColumn("mismatches", F.lit(mismatches))
    count = F.aggregate(F.filter(F.split("primer", ""), lambda c: c != ""), F.lit(1), lambda acc, c: acc * F.when(c.isin(*"ACGT"), 1).when(c.isin(*"RYSWKM"), 2).when(c.isin(*"BDHV"), 3).otherwise(4))
    base = base.withColumn("primer", F.when(count <= MOST_VARIANTS, F.col("primer")).otherwise(F.raise_error(F.concat(F.lit("too many variants of primer "), F.col("primer")))))
    seen = base.select("gene", "dir", "mismatches", "min_count", F.lit(0).alias("level"), F.explode(F.array_distinct(expand(F.col("primer")))).alias("oligo"))
    most = base.agg(F.max("mismatches")).first()[0] or 0
    places = F.sequence(F.lit(1), F.length("oligo"))
    for level in range(1, most + 1):
        wider = seen.where((F.col("level") == level - 1) & (F.col("mismatches") >= level))
        near = wider.select("gene", "dir", "mismatches", "min_count", F.explode(F.flatten(F.transform(places, lambda p: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.overlay(F.col("oligo"), b, p, F.lit(1)))))).alias("oligo"))
        fresh = near.distinct().withColumn("level", F.lit(level)).join(seen.select("gene", "dir", "oligo"), ["gene", "dir", "oligo"], "left_anti")
        # each level reads the one before it twice: written down, it is computed once
        seen = checkpointed(seen.unionByName(fresh))
    return seen.select("gene", "dir", "level", "oligo", "min_count")


def sieve(wanted: DataFrame, k: int):
    """``only`` of ``tally.counted``: the k-mers that may begin with an oligo on either strand; none where oligos are too many."""
    rows = wanted.select(F.length("oligo").alias("len"), encode("oligo").alias("first"), encode(revcomp("oligo")).alias("last")).distinct()
    found = rows.limit(BROADCAST_OLIGOS + 1).toPandas()
    if len(found) > BROADCAST_OLIGOS:
        return None
    spark = wanted.sparkSession
    ends = [(int(length), *(tally.Sieve(spark, own[end].to_numpy(dtype=np.int64)) for end in ("first", "last"))) for length, own in found.groupby("len")]

    def only(kmers: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(kmers), dtype=bool)
        for length, first, last in ends:
            kept |= first(kmers >> 2 * (k - length)) | last(kmers & ((1 << 2 * length) - 1))
        return kept

    return only


def match(counts: DataFrame, wanted: DataFrame, k: int, least: int = 0) -> DataFrame:
    """(gene, dir, level, kmer, n): oriented k-mers that begin with an oligo.

    A canonical k-mer matches as it is by its first bases or, only where that fails, as its
    reverse complement by its last ones. Counts are scanned once, with both numbers as keys
    of one equality join, and not shuffled while the oligos are few enough to broadcast.
    """
    listed = checkpointed(wanted.select("gene", "dir", "level", "min_count", F.length("oligo").alias("len"), encode("oligo").alias("first"), encode(revcomp("oligo")).alias("last")))
    lengths = sorted(r[0] for r in listed.select("len").distinct().collect())
    if not lengths:
        return counts.sparkSession.createDataFrame([], "gene string, dir string, level int, kmer bigint, n bigint")
    ends = lambda cols: F.explode(F.array(*[F.struct(F.lit(length).alias("len"), F.lit(end).alias("end"), key.cast("bigint").alias("key")) for length, end, key in cols])).alias("e")
    keys = [(length, end, key) for length in lengths for end, key in (("first", F.shiftright("kmer", 2 * (k - length))), ("last", F.col("kmer").bitwiseAND(F.lit((1 << (2 * length)) - 1))))]
    wide = counts.where(F.col("n") >= least).select("kmer", "n", ends(keys)).select("kmer", "n", "e.*")
    both = F.explode(F.array(*[F.struct(F.lit(end).alias("end"), F.col(end).alias("key")) for end in ("first", "last")])).alias("e")
    sought = listed.select("gene", "dir", "level", "min_count", "len", both).select("gene", "dir", "level", "min_count", "len", "e.*")
    if sought.count() <= BROADCAST_OLIGOS:
        sought = F.broadcast(sought)
    hits = wide.join(sought, ["len", "end", "key"]).where(F.col("n") >= F.col("min_count"))
    level = lambda end: F.min(F.when(F.col("end") == end, F.col("level")))
    found = hits.groupBy("gene", "dir", "kmer").agg(F.max("n").alias("n"), level("first").alias("ahead"), level("last").alias("behind"))
    oriented = F.when(F.col("ahead").isNotNull(), F.col("kmer")).otherwise(encode(revcomp(decode("kmer", k))))
    return found.select("gene", "dir", F.coalesce("ahead", "behind").alias("level"), oriented.alias("kmer"), "n")


def most_frequent(matched: DataFrame, most: int = MOST_KMERS) -> DataFrame:
    """At most ``most`` k-mers of each primer: fewer mismatches first, then by count."""
    order = Window.partitionBy("gene", "dir").orderBy("level", F.desc("n"), "kmer")
    return matched.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def stats(matched: DataFrame) -> DataFrame:
    """(gene, fwd_max, rev_max, fwd_median, rev_median, max_count, median_count): the last two are the lesser of both."""
    def side(name: str, f) -> Column:
        return f(F.when(F.col("dir") == name, F.col("n")))

    wide = matched.groupBy("gene").agg(side("fwd", F.max).alias("fwd_max"), side("rev", F.max).alias("rev_max"), side("fwd", F.median).alias("fwd_median"), side("rev", F.median).alias("rev_median"))
    lesser = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.least(a, b))
    return wide.select("*", lesser("fwd_max", "rev_max").alias("max_count"), lesser("fwd_median", "rev_median").alias("median_count"))


def thresholds(count: Column, least: Column) -> Column:
    """The coverages tried in turn: from half the primer's count down to ``least``."""
    high = F.floor(count / MULTIPLIER).cast("bigint")
    step = F.floor((high - least) / (STEPS - 1))
    ladder = F.concat(*[F.array((high - step * i).cast("bigint")) for i in range(STEPS - 1)], F.array(least.cast("bigint")))
    return F.when(high <= least, F.array(least.cast("bigint"))).otherwise(F.array_distinct(ladder))


def node_budget(bases: Column) -> Column:
    slope = (BUDGET_HIGH - BUDGET_LOW) / (BASES_HIGH - BASES_LOW)
    return F.when(bases <= BASES_LOW, BUDGET_LOW).when(bases >= BASES_HIGH, BUDGET_HIGH).otherwise((BUDGET_LOW + (bases - BASES_LOW) * slope)).cast("int")


def mismatches_at(seq: Column, primer: Column, start: Column) -> Column:
    """How many bases of ``seq`` from ``start`` (1-based) the primer's codes do not allow."""
    table = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, bases)])
    places = F.sequence(F.lit(0), F.length(primer) - 1)
    miss = lambda i: F.when(F.instr(table[F.substring(primer, i + 1, F.lit(1))], F.substring(seq, start + i, F.lit(1))) > 0, 0).otherwise(1)
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + miss(i))


def find(rows: DataFrame, key: str, seq: str, primer: str, mismatches: int = 2) -> DataFrame:
    """(key, start, stop): hits of a primer, exact ones if there are any, else with mismatches."""
    width = F.length(primer)
    starts = F.when(F.length(seq) >= width, F.sequence(F.lit(1), F.length(seq) - width + 1))
    each = rows.where(F.length(seq) >= width).select(key, seq, primer, F.explode(starts).alias("start"))
    scored = each.withColumn("miss", mismatches_at(F.col(seq), F.col(primer), F.col("start")))
    near = scored.where(F.col("miss") <= mismatches).withColumn("_least", F.min("miss").over(Window.partitionBy(key, primer)))
    return near.where((F.col("_least") > 0) | (F.col("miss") == 0)).select(key, (F.col("start") - 1).alias("start"), (F.col("start") - 1 + width).alias("stop"), "miss")


def amplicons(rows: DataFrame, key: str, seq: str, forward: str, reverse: str, shortest: int, longest: int, mismatches: int = 2) -> DataFrame:
    """(key, start, stop, amplicon): the shortest span from a forward to a reverse hit within bounds."""
    turned = rows.withColumn("_rc", revcomp(reverse))
    f = find(turned, key, seq, forward, mismatches).select(key, F.col("start").alias("a"))
    r = find(turned, key, seq, "_rc", mismatches).select(key, F.col("stop").alias("b"))
    spans = f.join(r, key).where((F.col("b") - F.col("a")).between(shortest, longest))
    first = Window.partitionBy(key).orderBy(F.col("b") - F.col("a"), "a")
    best = spans.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return best.join(rows.select(key, seq), key).select(key, F.col("a").alias("start"), F.col("b").alias("stop"), F.col(seq).substr(F.col("a") + 1, F.col("b") - F.col("a")).alias("amplicon"))


def binding(observed: DataFrame) -> DataFrame:
    """(gene, pos, code, seen, status, suggested) from rows (gene, primer, site) of the same length."""
    table = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, bases)])
    codes = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (bases, code)])
    each = observed.select("gene", "primer", F.posexplode(F.filter(F.split("site", ""), lambda c: c != "")).alias("pos", "base")).where(F.col("pos") < F.length("primer"))
    seen = each.groupBy("gene", "primer", "pos").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    code = F.substring("primer", F.col("pos") + 1, F.lit(1))
    allowed = F.filter(F.split(table[code], ""), lambda c: c != "")
    outside = F.size(F.array_except("bases", allowed)) > 0
    status = F.when(outside, "mismatch_absorbed").when(F.size(allowed) == 1, "fixed").when(F.size(F.array_intersect("bases", allowed)) == F.size(allowed), "fully_utilised").otherwise("could_reduce")
    union = F.concat_ws("", F.sort_array(F.array_union(allowed, F.col("bases"))))
    suggested = F.when(status == "mismatch_absorbed", codes[union]).when(status == "could_reduce", codes[F.concat_ws("", "bases")]).otherwise(code)
    return seen.select("gene", (F.col("pos") + 1).alias("pos"), code.alias("code"), F.concat_ws("", "bases").alias("seen"), status.alias("status"), suggested.alias("suggested"))
