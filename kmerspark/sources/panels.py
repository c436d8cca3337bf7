"""Primer panels: built in, from YAML files or addresses, or given in one string.

A panel's primers are a small table (a few dozen pairs), parsed on the driver; rules and
names are DataFrame expressions, so that tables of primers from elsewhere go the same way.
"""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerspark.operators.primers import DEFAULTS
from kmerspark.sources import published_primers

try:
    import yaml
except ImportError:  # only panels from files and addresses, and their export, need it
    yaml = None

MOST_BYTES, TIMEOUT = 10 * 1024 * 1024, 30
SCHEMA = "panel string, gene string, region string, index int, forward_seq string, reverse_seq string, min_length int, max_length int, min_count int, mismatches int, trim int, dedup_edit_threshold int, deprecated boolean, name string"
_FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
_INLINE = {"name": str, "forward": str.upper, "reverse": str.upper, "citation": str, "notes": str} | {c.replace("_", "-"): int for c in DEFAULTS}


class PanelError(ValueError):
    """A panel or primer specification that cannot be used."""


def parse_inline(spec: str) -> dict:
    """The pair of ``key=value,key=value``; keys in any case, each at most once, values after the first ``=``."""
    if not spec:
        raise PanelError("empty primer specification")
    given: dict[str, object] = {}
    for item in spec.split(","):
        key, equals, value = item.partition("=")
        key = key.lower()
        if not equals:
            raise PanelError(f"not key=value: {item!r}; values hold no commas, a panel file may")
        if key in given:
            raise PanelError(f"{key} is given twice")
        if key not in _INLINE:
            raise PanelError(f"unknown key {key}")
        # digits alone, as int() would also take blanks, signs and underscores
        if _INLINE[key] is int and not re.fullmatch(r"\+?[0-9]+", value):
            raise PanelError(f"{key} is not a number: {value!r}")
        given[key] = _INLINE[key](value)
    pair = dict(DEFAULTS) | {k.replace("-", "_"): v for k, v in given.items() if k not in ("name", "forward", "reverse", "citation", "notes")}
    return pair | {"name": given.get("name", ""), "forward_seq": given.get("forward", ""), "reverse_seq": given.get("reverse", "")}


def _builtin() -> dict[str, list[dict]]:
    panels: dict[str, list[dict]] = {name: [] for name in published_primers.CLADES}
    for line in published_primers.PAIRS.split("\n"):
        if line:
            panel, gene, region, index, forward, reverse, *numbers = line.split(" ")
            sizes = dict(zip(("min_length", "max_length", "min_count", "mismatches", "trim"), map(int, numbers)))
            panels[panel].append({"gene": gene, "region": None if region == "-" else region, "index": None if index == "-" else int(index), "forward_seq": forward, "reverse_seq": reverse} | sizes)
    return panels


def _fetch(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
        return answer.read(MOST_BYTES + 1)


def load(source: str, fetch: Callable[[str], bytes] = _fetch) -> tuple[str, list[dict]]:
    """(prefix of output names, pairs) of a built-in panel, a YAML file or an address."""
    if source in published_primers.CLADES:
        return source, _builtin()[source]
    remote = source.startswith(("http://", "https://"))
    if not remote and not re.search(r"[./]", source):
        raise PanelError(f"unknown panel {source}; there are {', '.join(published_primers.CLADES)}")
    if yaml is None:
        raise PanelError("panel files need the yaml package")
    if remote:
        text = fetch(source)
        if len(text) > MOST_BYTES:
            raise PanelError(f"{source} has more than {MOST_BYTES} bytes")
    else:
        with open(source, "rb") as file:
            text = file.read()
    try:
        panel = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise PanelError(f"{source} is not YAML: {error}") from error
    if not isinstance(panel, dict) or not isinstance(panel.get("primers"), list) or "name" not in panel:
        raise PanelError(f"{source} is not a panel: it needs a name and primers")
    if str(panel.get("schema_version")) == "2" and not panel.get("clade"):
        raise PanelError(f"{source} has schema version 2 but no clade")
    for pair in panel["primers"]:
        if not isinstance(pair, dict) or not {"gene", "forward_seq", "reverse_seq"} <= set(pair):
            raise PanelError(f"{source}: a primer pair needs gene, forward_seq and reverse_seq")
    return str(panel.get("gene_prefix") or panel["name"]), panel["primers"]


def frame(spark: SparkSession, panels: dict[str, list[dict]]) -> DataFrame:
    """(``SCHEMA``) of pairs by panel; defaults where a pair says nothing."""
    rows = []
    for panel, pairs in panels.items():
        for pair in pairs:
            row = dict(DEFAULTS) | {"deprecated": False} | {k: v for k, v in pair.items() if v is not None} | {"panel": panel}
            row |= {c: str(row[c]) for c in ("gene", "region") if row.get(c) is not None} | {c: str(row[c]).upper() for c in ("forward_seq", "reverse_seq")}
            rows.append(tuple(row.get(c) for c in _FIELDS))
    return spark.createDataFrame(rows, SCHEMA)


def builtin(spark: SparkSession) -> DataFrame:
    """The pairs of all built-in panels."""
    return frame(spark, _builtin())


def derived_name() -> Column:
    """``gene``, then ``-region`` and ``_index`` where given."""
    return F.concat("gene", F.coalesce(F.concat(F.lit("-"), "region"), F.lit("")), F.coalesce(F.concat(F.lit("_"), F.col("index").cast("string")), F.lit("")))


def rule_errors(primers: DataFrame) -> DataFrame:
    """(panel, gene, region, index, errors): what each pair breaks of the rules for names, in order."""
    n = F.count("*").over(Window.partitionBy("panel", "gene", "region", "index"))
    rules = [
        F.when(F.contains("gene", F.lit("_")), F.lit("underscore in gene")),
        F.when(F.col("region").isNotNull() & F.contains("gene", F.lit("-")), F.lit("hyphen in gene with a region")),
        F.when(F.contains("region", F.lit("_")), F.lit("underscore in region")),
        F.when(n > 1, F.lit("repeated gene, region and index")),
    ]
    return primers.select("panel", "gene", "region", "index", F.filter(F.array(*rules), lambda x: x.isNotNull()).alias("errors"))


def output_pairs(primers: DataFrame) -> DataFrame:
    """The pairs in use, ``gene`` as it names the output: panel, ``_``, derived name; a pair given inline has its own ``name``."""
    used = primers.where(~F.coalesce("deprecated", F.lit(False)))
    name = F.coalesce("name", F.concat("panel", F.lit("_"), derived_name()))
    return used.select(name.alias("gene"), "forward_seq", "reverse_seq", *DEFAULTS)


def clamped(pairs: DataFrame, min_kmer_count: int) -> DataFrame:
    """``min_count`` is never below the count that a k-mer needs to be kept at all."""
    return pairs.withColumn("min_count", F.greatest("min_count", F.lit(min_kmer_count)))


def repeated_names(pairs: DataFrame) -> DataFrame:
    """(gene, n) of output names that several pairs share."""
    return pairs.groupBy("gene").agg(F.count("*").alias("n")).where("n > 1")


def collect(spark: SparkSession, sources: list[str], inline: list[str], min_kmer_count: int = 2, fetch: Callable[[str], bytes] = _fetch) -> DataFrame:
    """The pairs of panels and inline specifications together, checked and clamped."""
    loaded = [load(source, fetch) for source in sources]
    tables = [frame(spark, {prefix: pairs}) for prefix, pairs in loaded]
    if inline:
        tables.append(frame(spark, {"": [parse_inline(spec) | {"gene": ""} for spec in inline]}))
    if not tables:
        raise PanelError("no primers given")
    for table in tables[: len(loaded)]:
        broken = rule_errors(table).where(F.size("errors") > 0).first()
        if broken:
            raise PanelError(f"panel {broken.panel}, gene {broken.gene}: {', '.join(broken.errors)}")
    pairs = clamped(output_pairs(_union(tables)), min_kmer_count)
    twice = repeated_names(pairs).orderBy("gene").first()
    if twice:
        raise PanelError(f"{twice.n} primer pairs are named {twice.gene}")
    return pairs


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every


def listing(spark: SparkSession) -> DataFrame:
    """(panel, version, clade, n_pairs) of the built-in panels."""
    rows = [(name, *published_primers.CLADES[name], len(pairs)) for name, pairs in _builtin().items()]
    return spark.createDataFrame(rows, "panel string, version string, clade string, n_pairs int")


def export(name: str) -> str:
    """A built-in panel as YAML, to be edited and loaded as a file."""
    if name not in published_primers.CLADES:
        raise PanelError(f"unknown panel {name}; there are {', '.join(published_primers.CLADES)}")
    if yaml is None:
        raise PanelError("export needs the yaml package")
    version, clade = published_primers.CLADES[name]
    pairs = [{k: v for k, v in pair.items() if v is not None} for pair in _builtin()[name]]
    return yaml.safe_dump({"name": name, "schema_version": "2", "panel_version": version, "description": f"Primers of {clade}", "clade": clade, "primers": pairs}, sort_keys=False)


def sample_name(sample: str | None = None, accession: str | None = None, organism: str | None = None) -> str:
    """The prefix of output files: as given, or of the organism and accession of a public run."""
    name = sample or (f"{organism.replace(' ', '_')}_{accession}" if organism and accession else accession)
    if not name:
        raise PanelError("a sample name is required")
    if not all(c.isalnum() or c in "_-." for c in name):
        raise PanelError(f"sample name {name!r} is not safe in file names: use letters, digits, _, - and .")
    return name
