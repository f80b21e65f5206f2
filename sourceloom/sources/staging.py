"""Written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sourceloom.session import checkpoint_dir

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, before)


def staged(df: DataFrame, fallback: str | None = None, small_batches: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Use it where an expensive table has several readers: each reads only its columns, and a lost
    executor re-reads files instead of repeating the work. Without a shared folder ``df`` stays lazy.
    With ``small_batches``, Python workers get their rows in batches of ``BATCH_BYTES`` meanwhile: they hold several batches
    at a time, and Spark's own default is 64 MB.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark, fallback)
    if base is None:
        return df
    path = f"{base.rstrip('/')}/staged/{uuid.uuid4().hex}"
    if small_batches:
        with _small_batches(spark):
            df.write.parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
