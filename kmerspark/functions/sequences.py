"""Column expressions on sequences and k-mers, all evaluated inside the JVM.

A k-mer is a BIGINT of two bits a base (A, C, G, T = 0..3), the first base in the high bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT_LIMIT = 2**32 - 1
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_CODES, _PAIRED = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(seq: Column | str) -> Column:
    """The number of a k-mer string of at most 31 bases."""
    return F.conv(F.translate(_col(seq), "ACGT", "0123"), 4, 10).cast("bigint")


def decode(kmer: Column | str, k: int | Column) -> Column:
    """The string of a k-mer number."""
    width = k if isinstance(k, Column) else F.lit(k)
    return F.translate(F.lpad(F.conv(_col(kmer).cast("string"), 10, 4), width, "0"), "0123", "ACGT")


def last_base(kmer: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, "ACGT")), _col(kmer).bitwiseAND(F.lit(3)).cast("int") + 1)


def revcomp(seq: Column | str) -> Column:
    """Reverse complement of a sequence, ambiguity codes included."""
    return F.reverse(F.translate(_col(seq), _CODES, _PAIRED))


def canonical(seq: Column | str) -> Column:
    return F.least(_col(seq), revcomp(seq))


def valid_bases(seq: Column | str) -> Column:
    """How many bases are not N."""
    return F.length(F.translate(_col(seq), "N", ""))


def subreads(seq: Column | str) -> Column:
    """The pieces between runs of N."""
    return F.filter(F.split(_col(seq), "N"), lambda x: x != "")


def is_iupac(seq: Column | str) -> Column:
    return _col(seq).rlike("^[ACGTRYSWKMBDHVN]+$")


def prefix_of(kmer: Column | str) -> Column:
    """The first k-1 bases of a k-mer."""
    return F.shiftright(_col(kmer), 2)


def suffix_of(kmer: Column | str, k: int) -> Column:
    """The last k-1 bases of a k-mer."""
    return _col(kmer).bitwiseAND(F.lit((1 << (2 * (k - 1))) - 1))


def edge_kmer(src: Column | str, dst: Column | str) -> Column:
    """The k-mer of the edge between two (k-1)-mers."""
    return F.shiftleft(_col(src), 2).bitwiseOR(_col(dst).bitwiseAND(F.lit(3)))


def saturated(n: Column | str) -> Column:
    """A count, held at the largest unsigned 32-bit number."""
    return F.least(_col(n), F.lit(COUNT_LIMIT)).cast("bigint")


def chunk_of(read_id: Column | str, chunks: int, batch: int = 1000) -> Column:
    """Batches of reads go to the chunks in turn."""
    return F.pmod(F.floor(_col(read_id) / batch), F.lit(max(chunks, 1))).cast("int")


def gene_name(gene: Column | str, region: Column | str, index: Column | str, prefix: Column | str | None = None) -> Column:
    """``[prefix_]gene[-region][_index]``."""
    name = F.concat(_col(gene), F.coalesce(F.concat(F.lit("-"), _col(region)), F.lit("")), F.coalesce(F.concat(F.lit("_"), _col(index).cast("string")), F.lit("")))
    return name if prefix is None else F.concat(F.coalesce(F.concat(_col(prefix), F.lit("_")), F.lit("")), name)


def format_count(n: Column | str) -> Column:
    return F.format_number(_col(n), 0)


def format_bytes(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n >= 1 << 30, F.concat(F.format_number(n / (1 << 30), 1), F.lit(" GB"))).when(n >= 1 << 20, F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MB"))).when(n >= 1 << 10, F.concat(F.format_number(n / (1 << 10), 1), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_duration(seconds: Column | str) -> Column:
    s = _col(seconds)
    return F.when(s >= 3600, F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s % 3600 / 60), F.lit("m"))).when(s >= 60, F.concat(F.floor(s / 60), F.lit("m "), F.floor(s % 60), F.lit("s"))).otherwise(F.concat(F.format_number(s, 1), F.lit("s")))


def primer_bits(primer: Column | str, mismatches: int = 0) -> Column:
    """Specificity of a primer: 2, 1, 0.42 or 0 bits a position, less 2 a mismatch allowed."""
    chars = F.filter(F.split(_col(primer), ""), lambda c: c != "")
    bit = lambda c: F.when(c.isin(*"ACGT"), 2.0).when(c.isin(*"RYSWKM"), 1.0).when(c.isin(*"BDHV"), 0.42).otherwise(0.0)
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + bit(c)) - 2.0 * mismatches


def kmer_coverage(coverage: Column | str, read_length: int, k: int) -> Column:
    """Expected k-mer coverage of a base coverage."""
    return _col(coverage) * (read_length - k + 1) / read_length


def chance_seen(kmer_cov: Column | str) -> Column:
    return 1 - F.exp(-_col(kmer_cov))
