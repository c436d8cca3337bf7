"""Queries of primer panels and of files written and read again, with their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from kmerspark.operators import histogram
from kmerspark.operators.primers import DEFAULTS
from kmerspark.plans import counting_queries as counts
from kmerspark.plans.pcr_queries import SQL_PAIRS
from kmerspark.session import shared_dir
from kmerspark.sources import fastq, panels, published_primers, sinks
from kmerspark.sources import synthetic as syn


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def panel_primers(spark, sf_dir):
    return panels.output_pairs(panels.builtin(spark))


def panel_list(spark, sf_dir):
    return panels.listing(spark)


def _named(spark, sf_dir):
    """Every benchmark item as a pair of a panel; some break a rule for names."""
    item = F.col("item_id")
    gene = F.concat(F.lit("g"), F.when(item % 7 == 0, "_").when(item % 5 == 0, "-").otherwise(""), (item % 40).cast("string"))
    region = F.when(item % 3 == 0, F.concat(F.lit("r"), F.when(item % 11 == 0, "_x").otherwise("")))
    return syn.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("p"), (item % 2).cast("string")).alias("panel"), gene.alias("gene"), region.alias("region"), F.when(item % 4 > 0, item % 4).cast("int").alias("index"))


def panel_rules(spark, sf_dir):
    return panels.rule_errors(_named(spark, sf_dir)).select("panel", "gene", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("index", F.lit(0)).alias("index"), F.concat_ws("; ", "errors").alias("errors"))


def panel_names(spark, sf_dir):
    return _named(spark, sf_dir).select("panel", panels.derived_name().alias("name"))


def primer_collect(spark, sf_dir):
    """Counts clamped to 3, and how many pairs share a name of seven."""
    number = F.regexp_extract("gene", "[0-9]+", 0).cast("int")
    pairs = syn.primers(spark, sf_dir).select(F.concat(F.lit("n"), (number % 7).cast("string")).alias("gene"), (number % 4 + 1).alias("min_count"))
    raised = panels.clamped(pairs, 3)
    return panels.repeated_names(raised).join(raised.groupBy("gene").agg(F.min("min_count").alias("least"), F.max("min_count").alias("most")), "gene")


def inline_primers(spark, sf_dir):
    """Each pair written as one string and parsed again."""
    spec = F.concat(F.lit("Name="), "gene", F.lit(",forward="), F.lower("forward_seq"), F.lit(",reverse="), "reverse_seq", F.lit(",max-length="), F.col("max_length").cast("string"), F.lit(",citation=a=b"))

    def parse(batches):
        for batch in batches:
            yield pd.DataFrame([panels.parse_inline(s) for s in batch["spec"]], columns=["name", "forward_seq", "reverse_seq", *DEFAULTS])

    schema = "name string, forward_seq string, reverse_seq string, " + ", ".join(f"{c} int" for c in DEFAULTS)
    return syn.primers(spark, sf_dir).select(spec.alias("spec")).mapInPandas(parse, schema)


def fasta_files(spark, sf_dir):
    rows = syn.templates(spark, sf_dir).select(F.concat(F.lit("g"), (F.col("item_id") % 5).cast("string")).alias("gene"), F.col("item_id").alias("product"), F.col("dna").alias("seq"), F.length("dna").alias("length"), F.lit(2.0).alias("median"), F.lit(1.5).alias("score"))
    folder = _folder(spark, "fasta")
    sinks.write_fasta(rows, folder, "bench")
    return sinks.read_fasta_files(spark, folder)


def histogram_files(spark, sf_dir):
    """The histogram of every prefix of the chunks, through its file."""
    wide = histogram.wide(counts._cumulative(spark, sf_dir), counts.CHUNKS)
    path, _ = sinks.write_histograms(wide, f"{_folder(spark, 'histogram')}/bench")
    found = sinks.read_histogram(spark, path)
    return found.select(*[F.col(c).cast("bigint") for c in found.columns])


def fastq_scan(spark, sf_dir):
    """All reads written as FASTQ files and scanned again, numbered over all files, every record checked."""
    folder = _folder(spark, "fastq")
    record = F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    ordered = syn.reads(spark, sf_dir).repartitionByRange("read_id").sortWithinPartitions("read_id")
    ordered.select(record.alias("value")).write.text(folder)
    return fastq.read(spark, [folder], validate_every=1)


_PUBLISHED = "pub AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x == "-" else x if x.isdigit() and i not in (1, 2) else f"'{x}'" for i, x in enumerate(line.split(" "))) + ")" for line in published_primers.PAIRS.split("\n") if line) + ") t(panel, gene, region, idx, forward_seq, reverse_seq, min_length, max_length, min_count, mismatches, trim))"
_NAMED = """nm AS (SELECT 'p' || CAST(item_id % 2 AS VARCHAR) AS panel, 'g' || CASE WHEN item_id % 7 = 0 THEN '_' WHEN item_id % 5 = 0 THEN '-' ELSE '' END || CAST(item_id % 40 AS VARCHAR) AS gene, CASE WHEN item_id % 3 = 0 THEN 'r' || CASE WHEN item_id % 11 = 0 THEN '_x' ELSE '' END END AS region, CASE WHEN item_id % 4 > 0 THEN CAST(item_id % 4 AS INTEGER) END AS "index" FROM benchmark)"""

SQL = {
    "panel_primers": f"WITH {_PUBLISHED} SELECT panel || '_' || gene || coalesce('-' || region, '') || coalesce('_' || CAST(idx AS VARCHAR), '') AS gene, forward_seq, reverse_seq, min_length, max_length, min_count, mismatches, trim, {DEFAULTS['dedup_edit_threshold']} AS dedup_edit_threshold FROM pub",
    "panel_list": f"WITH {_PUBLISHED}, v AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}', '{c}')" for n, (v, c) in published_primers.CLADES.items()) + ") t(panel, version, clade)) SELECT panel, version, clade, CAST(count(*) AS INTEGER) AS n_pairs FROM v JOIN pub USING (panel) GROUP BY ALL",
    "panel_rules": f"""WITH {_NAMED} SELECT panel, gene, coalesce(region, '') AS region, coalesce("index", 0) AS "index", array_to_string(list_filter([CASE WHEN contains(gene, '_') THEN 'underscore in gene' END, CASE WHEN region IS NOT NULL AND contains(gene, '-') THEN 'hyphen in gene with a region' END, CASE WHEN contains(region, '_') THEN 'underscore in region' END, CASE WHEN count(*) OVER (PARTITION BY panel, gene, region, "index") > 1 THEN 'repeated gene, region and index' END], lambda x: x IS NOT NULL), '; ') AS errors FROM nm""",
    "panel_names": f"""WITH {_NAMED} SELECT panel, gene || coalesce('-' || region, '') || coalesce('_' || CAST("index" AS VARCHAR), '') AS name FROM nm""",
    "primer_collect": f"WITH {SQL_PAIRS}, c AS (SELECT 'n' || CAST(item_id % 7 AS VARCHAR) AS gene, CAST(greatest(item_id % 4 + 1, 3) AS INTEGER) AS m FROM pairs) SELECT gene, count(*) AS n, min(m) AS least, max(m) AS most FROM c GROUP BY gene HAVING count(*) > 1",
    "inline_primers": f"WITH {SQL_PAIRS} SELECT gene AS name, forward_seq, reverse_seq, CAST(2 * length(dna) AS INTEGER) AS max_length, " + ", ".join(f"{v} AS {c}" for c, v in DEFAULTS.items() if c != "max_length") + " FROM pairs",
    "fasta_files": f"WITH {SQL_PAIRS} SELECT 'g' || CAST(item_id % 5 AS VARCHAR) AS gene, 'bench_g' || CAST(item_id % 5 AS VARCHAR) || '_' || CAST(item_id AS VARCHAR) AS name, dna AS seq FROM tmpl",
    "histogram_files": counts.SQL["kmer_histogram_wide"],
    "fastq_scan": f"WITH {counts.SQL_READS} SELECT read_id, seq FROM reads",
}
QUERIES = {name: globals()[name] for name in SQL}
