"""Ranking helpers that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column,
                rank: str = "rank", salt_by: Sequence[str] = (), salts: int = 64) -> DataFrame:
    """First ``n`` rows of every key in ``order``, numbered from 1.

    A hot key is first split into ``salts`` parts by a hash of ``salt_by``; every part keeps its own
    first ``n`` rows and only those meet in one task. The result does not depend on ``salts``.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    if salt_by and salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
        part = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (salted.withColumn("_part_rank", F.row_number().over(part))
              .where(F.col("_part_rank") <= limit).drop("_salt", "_part_rank"))
    whole = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= limit)
