"""Lineage cuts in the folder all executors share, and names that cannot clash with a caller's columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceloom.session import checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session names none (tests), a folder of its own."""
    path = checkpoint_dir(spark)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), f"checkpoints-{spark.sparkContext.applicationId}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


# Shuffle files of a step are freed once it is written, and texts go to Python in batches of a few megabytes.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder. A lost executor re-reads it; Spark drops it when unused.

    The shuffle files of the step are not needed once it is written, so Spark is asked to free them then: a chain
    of steps takes the disk of its largest.
    """
    shared_dir(df.sparkSession)
    with _step(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: compressed, and read by columns. The table stays in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(written_parts(df))


def written_parts(df: DataFrame, *parts: str) -> str:
    """Write ``df`` to a new folder of the shared one, with a folder ``name=value`` for each value of ``parts``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with _step(spark):
        df.write.partitionBy(*parts).parquet(path)
    return path


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


@contextmanager
def _step(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in STEP}
    for key, value in STEP.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of (id, text). Rows that share it hold the same text, so they get the same result; null ids
    and repeated ids are covered."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that a caller's names cannot meet those of a step; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``span``, spans). A row's place in its group, from 0, is ``before`` of its span plus its place there.

    Rows are dealt into ranges of (group, order), so a group of any size is spread over tasks; ``spans`` has the group,
    ``span``, and ``before`` and ``total`` (rows of the group before this span, and in all), one row for each range that a
    group touches. ``group`` must not hold nulls and ``order`` must tell all rows apart.
    """
    ranged = cut(rows.repartitionByRange(*group, *order).withColumn("span", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "span").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, cut(counts.select(*group, "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                                     F.sum("n").over(whole).alias("total")))


def place(group: list[str], order: list[str]) -> Column:
    """The place of a row of ``numbered`` that was joined with its span."""
    return F.col("before") + F.row_number().over(Window.partitionBy(*group, "span").orderBy(*order)) - 1
