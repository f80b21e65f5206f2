"""Parallelism of CPU-heavy stages over small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` when the scan has fewer partitions than the cluster has cores.

    A table of many files keeps its scan partitions and pays no shuffle. A table of one or two files
    would otherwise run text work on one or two cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys)
