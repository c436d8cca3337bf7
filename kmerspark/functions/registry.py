"""The sequence functions under SQL names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kmerspark.operators import kmers as km


@F.pandas_udf("bigint")
def kmer_revcomp(kmer: pd.Series, k: pd.Series) -> pd.Series:
    out = np.zeros(len(kmer), dtype=np.int64)
    rest, width = kmer.to_numpy(dtype=np.int64).copy(), k.to_numpy()
    for i in range(int(width.max()) if len(width) else 0):
        live = i < width
        out[live] = (out[live] << 2) | (3 - (rest[live] & 3))
        rest >>= 2
    return pd.Series(out)


@F.udtf(returnType="pos int, kmer bigint")
class Kmers:
    """``kmers(seq, k)``: the canonical k-mers of a sequence, in order."""

    def eval(self, seq: str, k: int):
        if seq is not None:
            positions, values = km.sequence_kmers(seq, k)
            yield from zip(positions.tolist(), values.tolist())


def register(spark: SparkSession) -> None:
    """Make ``kmer_revcomp``, ``kmers``, ``kmer_encode``, ``kmer_decode`` and ``revcomp`` known to SQL."""
    spark.udf.register("kmer_revcomp", kmer_revcomp)
    spark.udtf.register("kmers", Kmers)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_encode(s STRING) RETURNS BIGINT RETURN cast(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_decode(v BIGINT, k INT) RETURNS STRING RETURN translate(lpad(conv(cast(v AS STRING), 10, 4), k, '0'), '0123', 'ACGT')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))")
