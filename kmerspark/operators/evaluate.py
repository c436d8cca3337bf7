"""Results against references: score codes, result grids, parameter sweeps.

``eval`` rows are (panel, accession, taxon, max_reads, gene, recovered, n_products, length,
matched_gene, matched_taxon, pct_identity, on_target).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOBS = ("k", "max_primer_kmers", "high_coverage_ratio", "tip_coverage_fraction")


def references(panels: DataFrame) -> DataFrame:
    """(gene, taxon, accession, sequence) from the nested references of panels."""
    blocks = panels.select(F.explode("references").alias("r")).select("r.gene", F.explode("r.sequences").alias("s"))
    return blocks.select("gene", "s.taxon", "s.accession", "s.sequence")


def best_reference(products: DataFrame, refs: DataFrame) -> DataFrame:
    """(gene, product, matched_taxon, pct_identity): the reference of the gene nearest by edit distance.

    Stands in for an external alignment search, as identity over the longer of the two.
    """
    both = products.join(refs.select("gene", F.col("taxon").alias("matched_taxon"), F.col("sequence").alias("_ref")), "gene")
    longer = F.greatest(F.length("seq"), F.length("_ref"))
    identity = 100.0 * (1 - F.levenshtein("seq", "_ref") / longer)
    best = F.max(F.struct(identity.alias("pct_identity"), "matched_taxon")).alias("b")
    return both.groupBy("gene", "product").agg(best).select("gene", "product", "b.matched_taxon", "b.pct_identity")


def score_code(recovered: Column, has_refs: Column, has_taxon: Column, identity: Column, on_target: Column, matched: Column) -> Column:
    """Three signs: recovered; a reference exists (* of this taxon); the match (* on target)."""
    first = F.when(recovered, "+").otherwise("-")
    second = F.when(~has_refs, "-").when(has_taxon, "*").otherwise("+")
    third = F.when(~recovered | identity.isNull(), "-").when(on_target, "*").when(matched.isNotNull(), "+").otherwise("-")
    return F.concat(first, second, third)


def scored(results: DataFrame, refs: DataFrame) -> DataFrame:
    """``results`` with ``score`` and ``points``."""
    genes = refs.select("gene").distinct().withColumn("_refs", F.lit(True))
    taxa = refs.select("gene", "taxon").distinct().withColumn("_taxon", F.lit(True))
    both = results.join(genes, "gene", "left").join(taxa, ["gene", "taxon"], "left")
    code = score_code(F.col("recovered"), F.coalesce("_refs", F.lit(False)), F.coalesce("_taxon", F.lit(False)), F.col("pct_identity"), F.coalesce("on_target", F.lit(False)), F.col("matched_gene"))
    return both.withColumn("score", code).withColumn("points", points(F.col("score"))).drop("_refs", "_taxon")


def points(score: Column) -> Column:
    return F.when(score == "+**", 3).when(score == "+++", 2).when(score == "+--", 1).otherwise(0)


def complete(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every declared gene of every run, recovered or not."""
    return declared.join(found.withColumn("_found", F.lit(True)), keys, "left").withColumn("recovered", F.coalesce("_found", F.lit(False))).drop("_found")


def deepest(results: DataFrame) -> DataFrame:
    """The rows of each sample's largest ``max_reads``."""
    most = F.max("max_reads").over(Window.partitionBy("panel", "accession"))
    return results.withColumn("_most", most).where(F.col("max_reads") == F.col("_most")).drop("_most")


def grid(results: DataFrame, depths: list[int]) -> DataFrame:
    """(panel, accession, gene, reads_<depth>...): the score at each depth, ``.`` where not run."""
    wide = results.groupBy("panel", "accession", "gene").pivot("max_reads", depths).agg(F.max("score"))
    return wide.select("panel", "accession", "gene", *[F.coalesce(F.col(str(d)), F.lit(".")).alias(f"reads_{d}") for d in depths])


def parse_label(label: Column) -> tuple[Column, Column]:
    """(knob, value) of ``sweep_<knob>_<value>``; null for unknown knobs."""
    pattern = f"^sweep_({'|'.join(sorted(KNOBS, key=len, reverse=True))})_(.+)$"
    known = label.rlike(pattern)
    return F.when(known, F.replace(F.regexp_extract(label, pattern, 1), F.lit("_"), F.lit("-"))), F.when(known, F.regexp_extract(label, pattern, 2))


def sweep(rows: DataFrame) -> DataFrame:
    """(knob, value, points, rank) from (label, stamp, panel, accession, max_reads, gene, score).

    Of several runs of one knob, panel and value only the latest counts, at the deepest tier.
    """
    knob, value = parse_label(F.col("label"))
    parsed = rows.withColumn("knob", knob).withColumn("value", value).where("knob is not null")
    latest = F.max("stamp").over(Window.partitionBy("knob", "panel", "value"))
    current = parsed.withColumn("_latest", latest).where(F.col("stamp") == F.col("_latest"))
    most = F.max("max_reads").over(Window.partitionBy("knob", "value", "panel", "accession"))
    tier = current.withColumn("_most", most).where(F.col("max_reads") == F.col("_most"))
    total = tier.groupBy("knob", "value").agg(F.sum(points(F.col("score"))).alias("points"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("knob").orderBy(F.desc("points"), "value")))


def best_run(found: DataFrame) -> DataFrame:
    """Of each gene and accession, the product of the deepest run that has any."""
    order = Window.partitionBy("gene", "accession").orderBy(F.desc("max_reads"), F.desc("score"), "seq")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def performance(results: DataFrame) -> DataFrame:
    """(panel, max_reads, runs, wall_time_s, recovered, declared)."""
    return results.groupBy("panel", "max_reads").agg(F.countDistinct("accession").alias("runs"), F.sum("wall_time_s").alias("wall_time_s"), F.sum(F.col("recovered").cast("int")).alias("recovered"), F.count("*").alias("declared"))
