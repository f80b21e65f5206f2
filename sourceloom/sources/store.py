"""The chunk store and the result writers.

Layout: ``<store>/chunks/repo_id=<id>/`` holds rows, ``<store>/deleted/`` holds tombstones
(repo_id, seq). A delete writes a tombstone and touches no data; rows at or below its ``seq`` are
hidden from every read and disappear when the repository is written next.

A merge writes the new rows of its repositories to ``<store>/pending`` before the old ones go. If it stops after that,
reads take those repositories from there, and the next merge (or ``finish_merge``) puts them in place first.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.operators.repos import upsert
from sourceloom.sources.staging import staged

TOMBSTONE = "repo_id string, seq bigint"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a folder. Ids in folder names stay text: ``007`` and ``1e5`` are not numbers."""
    try:
        found = spark.read.option("mergeSchema", "false").parquet(path)
        fields = [T.StructField(f.name, T.StringType() if f.name == "repo_id" else f.dataType) for f in found.schema]
        return spark.read.schema(T.StructType(fields)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _pending(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of a merge that wrote all of them and did not end."""
    files, done = _folder(spark, f"{store}/pending/_SUCCESS")
    return _read(spark, f"{store}/pending") if files.exists(done) else None


def finish_merge(spark: SparkSession, store: str) -> None:
    """Put the rows of a merge that was stopped in place. Doing it again changes nothing."""
    pending = _pending(spark, store)
    if pending is not None:
        # Rebalancing splits a large repository over several files and merges small ones.
        (pending.hint("rebalance", "repo_id").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{store}/chunks"))
    files, folder = _folder(spark, f"{store}/pending")
    files.delete(folder, True)


def read_store(spark: SparkSession, store: str) -> DataFrame | None:
    """All live rows, or None for a store that was never written. Filters on repo_id prune files."""
    rows = _read(spark, f"{store}/chunks")
    pending = _pending(spark, store)
    if pending is not None:
        rows = pending if rows is None else rows.join(pending.select("repo_id").distinct(), "repo_id", "left_anti") \
            .unionByName(pending, allowMissingColumns=True)
    if rows is None:
        return None
    deleted = _read(spark, f"{store}/deleted")
    if deleted is None:
        return rows
    last = deleted.groupBy("repo_id").agg(F.max("seq").alias("_deleted"))
    joined = rows.join(last, "repo_id", "left")
    return joined.where(F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted"))).drop("_deleted")


def upsert_store(spark: SparkSession, incoming: DataFrame, store: str) -> None:
    """Merge ``incoming`` (id, repo_id, seq, ...) into the store; the last row of an id wins.

    Only the partitions of the repositories in ``incoming`` are read and replaced, and only once their new rows
    are written beside them. A lost executor only repeats its tasks. Running the same merge again changes nothing.
    One merge at a time may run on a store.
    """
    finish_merge(incoming.sparkSession, store)
    incoming = staged(incoming)     # read three times below: keys, rows, repositories
    live = read_store(spark, store)
    if live is None:
        merged = upsert(incoming.limit(0), incoming)
    else:
        touched = incoming.select("repo_id").distinct()
        # A store written before a column existed has no values there.
        old = [F.col(f.name) if f.name in live.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in incoming.schema]
        merged = upsert(live.join(touched, "repo_id", "left_semi").select(*old), incoming)
    merged.hint("rebalance", "repo_id").write.mode("overwrite").partitionBy("repo_id").parquet(f"{store}/pending")
    finish_merge(incoming.sparkSession, store)


def delete_from_store(deleted: DataFrame, store: str) -> None:
    """Hide all rows of the given repositories (``repo_id``, ``seq``)."""
    deleted.select("repo_id", F.col("seq").cast("bigint").alias("seq")).write.mode("append").parquet(
        f"{store}/deleted")


def write_eval_run(results: DataFrame, scores: DataFrame, path: str, run: str) -> None:
    """Scores and raw results of an evaluation run as JSON, partitioned by provider and run."""
    for name, df in (("scores", scores), ("results", results)):
        (df.withColumn("run", F.lit(run)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("provider", "run")
         .json(f"{path}/{name}"))


def write_ingest_summary(summary: DataFrame, path: str, run: str) -> None:
    """One JSON row per repository of an ingestion run."""
    (summary.withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path))


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").parquet(path)
