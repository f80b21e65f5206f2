"""Job and status streams.

Delivery of jobs is at least once. A job's attempts are counted in the state of the stream: a job that is delivered
again while it runs, or after it ended, adds nothing; one that failed runs again until its last attempt, and then goes
to the dead letters, while the stream goes on. What runs twice is harmless: chunk ids are deterministic, the store merge
is idempotent, and a micro-batch that runs again replaces its own events.

A repository passes through queued, cloning, chunking, embedding, and ready or failed. The event of a phase is written when the phase begins or
ends, not with the others at the end, so a reader of the events sees a repository move.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.repos import decode_jobs, repo_latest, stored_summary
from sourceloom.plans.ingest import job_rows
from sourceloom.session import checkpoint_dir
from sourceloom.sources.staging import staged
from sourceloom.sources.store import upsert_store

log = logging.getLogger(__name__)

JOB_KEY = ["repo_id", "github_url", "branch"]
ATTEMPTS = 3             # fixed value: runs of a job before it is given up
ERROR_CHARS = 500        # of an error, what an event keeps
OUTCOME = "repo_id string, github_url string, branch string, attempt int, kind string, error string, arrived timestamp"
ATTEMPT = "repo_id string, github_url string, branch string, attempt int, action string, error string, arrived timestamp"


def message_stream(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Messages (one JSON text per line) with the arrival time of their file."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path))
    return lines.select("value", F.col("_metadata.file_modification_time").alias("arrived"))


def job_stream(messages: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Valid jobs; a job that arrives again within ``horizon`` adds no row."""
    jobs = decode_jobs(messages).where(F.col("outcome") == "job")
    return (jobs.withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(JOB_KEY)
            .select(*JOB_KEY, "arrived"))


def outcome_stream(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes of attempts, as ``run_jobs`` writes them."""
    spark.createDataFrame([], OUTCOME).write.mode("append").parquet(path)       # the folder must exist
    return spark.readStream.schema(OUTCOME).parquet(path)


def attempt_stream(messages: DataFrame, outcomes: DataFrame, attempts: int = ATTEMPTS,
                   horizon_seconds: int = 86_400) -> DataFrame:
    """What to do: ``run`` a job as its ``attempt``, or ``dead``, with the last error, after ``attempts`` failures.

    The state of a job is its attempt and whether that is running, done or dead. An outcome counts only for the attempt
    that is running, so an outcome that is read twice counts once. A job without news for ``horizon_seconds`` is
    forgotten; it would start anew. News count from the micro-batch that reads them, so none is ever late.
    """
    def follow(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        attempt, status = state.get if state.exists else (0, "new")
        out = []
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.kind == "job", r.attempt)):
            action = None
            if row.kind == "job" and status == "new":
                attempt, status, action = 1, "running", "run"
            elif row.kind == "done" and status == "running" and row.attempt == attempt:
                status = "done"
            elif row.kind == "failed" and status == "running" and row.attempt == attempt:
                if attempt < attempts:
                    attempt, action = attempt + 1, "run"
                else:
                    status, action = "dead", "dead"
            if action:
                out.append((*key, attempt, action, row.error if action == "dead" else None, row.arrived))
        state.update((attempt, status))
        state.setTimeoutTimestamp(int(row.arrived.timestamp() + horizon_seconds) * 1000)
        yield pd.DataFrame(out, columns=[*JOB_KEY, "attempt", "action", "error", "arrived"])

    jobs = decode_jobs(messages).where(F.col("outcome") == "job").select(
        *JOB_KEY, F.lit(0).alias("attempt"), F.lit("job").alias("kind"), F.lit(None).cast("string").alias("error"), "arrived")
    news = jobs.unionByName(outcomes).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 minute")
    return news.groupBy(*JOB_KEY).applyInPandasWithState(
        follow, ATTEMPT, "attempt int, status string", "append", "EventTimeTimeout")


def dead_letter_stream(messages: DataFrame) -> DataFrame:
    """Messages that are acknowledged but not run."""
    return decode_jobs(messages).where(F.col("outcome") == "dead_letter").select("value", "arrived")


def _checkpoint(spark: SparkSession, checkpoint: str | None, name: str) -> str:
    base = checkpoint_dir(spark, checkpoint)
    if base is None:
        raise ValueError("no checkpoint folder: set spark.checkpoint.dir or pass checkpoint=")
    return f"{base}/{name}"


class _Phases:
    """Writes the event of each phase of a micro-batch when it is reached, and tells the status hook."""

    def __init__(self, folder: str, on_status: Callable[[DataFrame], None] | None):
        self.folder, self.on_status, self.step = folder, on_status, 0
        # Later batches have later numbers, also after a fresh checkpoint.
        self.first = int(time.time() * 1000) * 1000

    def reach(self, rows: DataFrame, status: str, error: str | None = None) -> None:
        """``rows``: repo_id, url, branch, and with the phases that know them file_count and chunk_count."""
        count = [(F.col(c) if c in rows.columns else F.lit(None)).cast("int").alias(c) for c in ("file_count", "chunk_count")]
        note = F.col("error") if "error" in rows.columns and error is None else F.lit(error)
        path = f"{self.folder}/step={self.step}"
        rows.select("repo_id", F.lit(self.first + self.step).cast("bigint").alias("seq"), F.current_timestamp().alias("ts"),
                    F.lit(status).alias("status"), "url", "branch", *count, note.cast("string").alias("error")
                    ).coalesce(1).write.mode("overwrite").parquet(path)
        self.step += 1
        if self.on_status is not None:
            try:
                self.on_status(rows.sparkSession.read.parquet(path))
            except Exception:  # noqa: BLE001 - a status hook must not fail the job
                log.warning("status hook failed at %s", path, exc_info=True)


def _ingest(repos: DataFrame, files: DataFrame, store: str, phases: _Phases, limits: Limits,
            checkpoint: str | None) -> None:
    """All phases of some repositories; raises what fails."""
    phases.reach(repos, "cloning")
    wanted = files.join(repos.select("repo_id"), "repo_id", "left_semi")
    phases.reach(repos, "chunking")
    rows = staged(job_rows(repos, wanted, limits).withColumn("seq", F.lit(phases.first + phases.step).cast("bigint")), checkpoint)
    summary = staged(stored_summary(repos, rows.select("repo_id", "file_path")), checkpoint)
    found = summary.where(F.col("status") != "failed")
    phases.reach(summary.where(F.col("status") == "failed"), "failed")
    phases.reach(found.drop("error"), "embedding")
    upsert_store(repos.sparkSession, rows, store)
    phases.reach(found.drop("error"), "ready")


def _ingest_apart(repos: DataFrame, run: Callable[[DataFrame], None], failed: Callable[[DataFrame, str], None],
                  depth: int = 0) -> None:
    """Run some repositories together; if that fails, halves of them, down to the ones that fail alone."""
    try:
        run(repos)
    except Exception as e:  # noqa: BLE001 - a repository that fails must not stop the others
        if repos.limit(2).count() < 2:
            log.warning("repository failed", exc_info=True)
            failed(repos, str(e)[:ERROR_CHARS])
            return
        side = F.pmod(F.xxhash64("repo_id", F.lit(depth)), F.lit(2))
        for half in (0, 1):
            part = repos.where(side == half)
            if not part.isEmpty():
                _ingest_apart(part, run, failed, depth + 1)


def run_jobs(jobs: DataFrame, files: DataFrame, store: str, events: str,
             checkpoint: str | None = None, limits: Limits = DEFAULTS,
             on_status: Callable[[DataFrame], None] | None = None, name: str = "ingest_jobs",
             outcomes: str | None = None, dead_letters: str | None = None) -> StreamingQuery:
    """Ingest the repositories of a job stream from the table ``files`` into ``store``.

    ``jobs`` is a ``job_stream``, whose failures end as ``failed``, or an ``attempt_stream``, whose outcomes go to
    ``outcomes`` (read back by the stream) and whose lost jobs go to ``dead_letters``. Life-cycle events go to ``events``
    and to ``on_status``, whose errors never fail a job. ``name`` identifies the stream below the shared checkpoint folder
    and must stay the same over restarts.
    """
    spark = jobs.sparkSession
    counted = "attempt" in jobs.columns
    if counted and (outcomes is None or dead_letters is None):
        raise ValueError("an attempt_stream needs folders for outcomes and dead letters")
    folder = _checkpoint(spark, checkpoint, name)

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query_id = session.read.json(f"{folder}/metadata").first()["id"]         # another one after a fresh checkpoint
        own = f"run={query_id}/batch={batch_id}"
        rows = staged(batch if counted else batch.withColumns({"attempt": F.lit(1), "action": F.lit("run")}), checkpoint)
        if counted:
            (rows.where(F.col("action") == "dead").select(*JOB_KEY, "attempt", "error", "arrived").coalesce(1)
             .write.mode("overwrite").json(f"{dead_letters}/{own}"))
        to_run = rows.where(F.col("action") == "run")
        newest = F.max(F.struct("arrived", "github_url", "branch")).alias("_job")
        repos = staged(to_run.groupBy("repo_id").agg(newest).select(
            "repo_id", F.col("_job.github_url").alias("url"), F.col("_job.branch").alias("branch")), checkpoint)
        if repos.isEmpty():
            return
        phases, errors = _Phases(f"{events}/{own}", on_status), []

        def failed(one: DataFrame, error: str) -> None:
            phases.reach(one, "failed", error)
            errors.append((one.first()["repo_id"], error))

        phases.reach(repos, "queued")
        _ingest_apart(repos, lambda some: _ingest(some, files, store, phases, limits, checkpoint), failed)
        if counted:
            # One row for each repository that failed alone in this micro-batch.
            lost = session.createDataFrame(errors, "repo_id string, _error string")
            ended = to_run.join(lost, "repo_id", "left").select(
                *JOB_KEY, "attempt", F.when(F.col("_error").isNull(), "done").otherwise("failed").alias("kind"),
                F.col("_error").alias("error"), F.current_timestamp().alias("arrived"))
            # If this batch runs again its outcomes are appended again, and count once: they name their attempt.
            ended.coalesce(1).write.mode("append").parquet(outcomes)

    return (jobs.writeStream.foreachBatch(run).queryName(name)
            .option("checkpointLocation", folder).trigger(availableNow=True).start())


def write_dead_letters(messages: DataFrame, path: str, checkpoint: str | None = None,
                       name: str = "dead_letters") -> StreamingQuery:
    return (dead_letter_stream(messages).writeStream.format("json").option("path", path)
            .queryName(name)
            .option("checkpointLocation", _checkpoint(messages.sparkSession, checkpoint, name))
            .trigger(availableNow=True).start())


def event_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def status_stream(events: DataFrame) -> DataFrame:
    """Current row of every repository over a stream of events (same result as the batch form)."""
    return repo_latest(events)


def watch_status(events: DataFrame, on_rows: Callable[[DataFrame], None], checkpoint: str | None = None,
                 name: str = "status") -> StreamingQuery:
    """Hand on the current rows of the repositories that changed, micro-batch by micro-batch (update mode)."""
    return (status_stream(events).writeStream.outputMode("update").queryName(name)
            .foreachBatch(lambda rows, batch_id: on_rows(rows))
            .option("checkpointLocation", _checkpoint(events.sparkSession, checkpoint, name))
            .trigger(availableNow=True).start())
