"""Jobs, repositories and the table of chunks over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.text import as_column, or_default, strip
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.sources.staging import staged

JOB = "repo_id string, github_url string, branch string"
NO_FILES = "No supported source files found in repository"  # fixed value


def clean_url(url: Column | str) -> Column:
    """Address without outer white space, trailing slashes and a ``.git`` ending."""
    return F.regexp_replace(F.rtrim(strip(url), F.lit("/")), r"\.git$", "")


def repo_name(url: Column | str) -> Column:
    """Display name: the text after the last host part, or the whole address."""
    return F.substring_index(as_column(url), rules.REPO_HOST, -1)


def repo_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``clean_url``, ``repo_name`` and ``outcome`` (accepted or invalid)."""
    df = urls.withColumn("clean_url", clean_url(url))
    valid = F.coalesce(F.col("clean_url").rlike(rules.REPO_URL), F.lit(False))
    return df.withColumns({
        "repo_name": repo_name("clean_url"),
        "outcome": F.when(valid, "accepted").otherwise("invalid"),
    })


def decode_jobs(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decode job messages. ``outcome`` is ``job``, or ``dead_letter`` where an id or address lacks."""
    parsed = messages.withColumn("_job", F.from_json(F.col(value), JOB))
    df = parsed.select(*messages.columns, "_job.repo_id", "_job.github_url",
                       F.coalesce("_job.branch", F.lit("main")).alias("branch"))
    complete = (or_default("repo_id", F.lit(None)).isNotNull()
                & or_default("github_url", F.lit(None)).isNotNull())
    return df.withColumn("outcome", F.when(complete, "job").otherwise("dead_letter"))


def job_payloads(messages: DataFrame, value: str = "value") -> DataFrame:
    """Distinct valid jobs: a message that is delivered again adds no row."""
    jobs = decode_jobs(messages, value).where(F.col("outcome") == "job")
    return jobs.select("repo_id", "github_url", "branch").distinct()


def create_repos(jobs: DataFrame, repo_id: Column | None = None) -> DataFrame:
    """First event of every submitted repository (``url``, ``branch``): queued, now, with a new id."""
    return jobs.select(
        (F.uuid() if repo_id is None else repo_id).alias("repo_id"), F.lit(0).cast("bigint").alias("seq"),
        F.current_timestamp().alias("ts"), F.lit("queued").alias("status"), "url",
        F.coalesce("branch", F.lit("main")).alias("branch"),
        F.lit(None).cast("int").alias("file_count"), F.lit(None).cast("int").alias("chunk_count"),
        F.lit(None).cast("string").alias("error"))


def latest(column: str) -> Column:
    """Last non-null value in ``seq`` order: a null never overwrites."""
    order = F.when(F.col(column).isNotNull(), F.col("seq"))
    return F.max_by(F.col(column), order).alias(column)


def repo_latest(events: DataFrame) -> DataFrame:
    """Current row of every repository from its events.

    Aggregation is partial on the map side, so a repository with very many events is no hot spot.
    """
    return events.groupBy("repo_id").agg(
        latest("url"), latest("branch"), latest("status"), latest("file_count"),
        latest("chunk_count"), latest("error"), F.min("ts").alias("created_at"),
        F.max_by("ts", "seq").alias("updated_at"))


def run_stamp(at: Column | None = None) -> Column:
    """Name of a run that starts ``at`` (now): date and time to the second."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def elapsed_ms(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds from ``start`` to ``end``; null if either is."""
    return F.unix_millis(as_column(end).cast("timestamp")) - F.unix_millis(as_column(start).cast("timestamp"))


def job_durations(events: DataFrame) -> DataFrame:
    """Seconds from the first ``cloning`` of a repository to its last end (ready or failed); null while it runs."""
    ended = F.max(F.when(F.col("status").isin("ready", "failed"), F.col("ts")))
    started = F.min(F.when(F.col("status") == "cloning", F.col("ts")))
    spans = events.groupBy("repo_id").agg(started.alias("started_at"), ended.alias("ended_at"))
    seconds = elapsed_ms("started_at", "ended_at") / 1000
    return spans.withColumn("duration_seconds", F.when(F.col("ended_at") >= F.col("started_at"), seconds))


def repo_list(repos: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """The newest repositories with a known status, with the true total and the returned number."""
    known = repos.where(F.col("status").isin(rules.STATES))
    newest = known.orderBy(F.desc("created_at"), F.asc("repo_id")).limit(limits.list_limit)
    total = known.agg(F.count(F.lit(1))).scalar()
    return newest.withColumn("total", total).withColumn(
        "returned", F.least(F.col("total"), F.lit(limits.list_limit)))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Rows of ``existing`` replaced or extended by the last incoming row of every key.

    A key that is delivered very often collapses on the map side; existing rows are only tested
    against the incoming keys.
    """
    rest = [c for c in incoming.columns if c != key]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(
        key, *[f"_row.{c}" for c in rest])
    keys = incoming.select(key).distinct()
    return existing.join(keys, key, "left_anti").unionByName(last.select(*existing.columns))


def delete_repos(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of all repositories except the deleted ones. Serves vectors and repository rows alike."""
    return rows.join(deleted.select("repo_id").distinct(), "repo_id", "left_anti")


def upsert_batches(chunked: DataFrame, is_valid: Callable[[Column], Column],
                   limits: Limits = DEFAULTS) -> DataFrame:
    """Success accounting by batches of consecutive chunks; a batch with an invalid row fails whole.

    ``chunked`` holds one row per file with its ``chunks`` array. The place of a chunk in its
    repository is the number of chunks in earlier files plus its place in the file. Flags are sorted
    into ranges of (repository, path); sums of whole ranges and a window inside each give the place,
    so contents are not shuffled and no task holds a large repository.
    """
    flags = F.transform("chunks", lambda c: F.coalesce(is_valid(c), F.lit(False)))
    files = chunked.select("repo_id", F.split("path", "/", -1).alias("_parts"), flags.alias("_ok"))
    # Written once, so that a row has the same range for both of its readers.
    ranged = staged(files.repartitionByRange("repo_id", "_parts").withColumn("_range", F.spark_partition_id()))

    def earlier(keys: list[str], order: str, size: Column) -> Column:
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(before), F.lit(0))

    ranges = ranged.groupBy("repo_id", "_range").agg(F.sum(F.size("_ok")).alias("_n"))
    starts = ranges.select("repo_id", "_range", earlier(["repo_id"], "_range", F.col("_n")).alias("_start"))
    offset = F.col("_start") + earlier(["repo_id", "_range"], "_parts", F.size("_ok"))
    rows = ranged.join(starts, ["repo_id", "_range"]).withColumn("_offset", offset).select(
        "repo_id", "_offset", F.posexplode("_ok").alias("_place", "ok"))
    batch = F.floor((F.col("_offset") + F.col("_place")) / limits.upsert_batch).cast("bigint")
    n = F.count(F.lit(1))
    return rows.groupBy("repo_id", batch.alias("batch")).agg(
        n.alias("row_count"), F.min("ok").alias("ok"),
        F.when(F.min("ok"), n).otherwise(F.lit(0)).alias("upserted"))


def ingest_summary(repos: DataFrame, chunked: DataFrame,
                   is_valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """Files, chunks and vectors per repository; a repository without eligible files has failed.

    ``chunked`` holds one row per eligible file with its ``chunks`` array, so that one scan and one
    partial aggregation give all three counts. ``is_valid`` tells which chunks can be stored.
    """
    stored = F.col("chunks") if is_valid is None else F.filter("chunks", is_valid)
    per_file = chunked.select("repo_id", F.size("chunks").alias("n"), F.size(stored).alias("stored"))
    return _summary(repos, per_file)


def stored_summary(repos: DataFrame, rows: DataFrame) -> DataFrame:
    """The same summary from stored chunk rows (every eligible file has at least one chunk)."""
    n = F.count(F.lit(1))
    return _summary(repos, rows.groupBy("repo_id", "file_path").agg(n.alias("n"), n.alias("stored")))


def _summary(repos: DataFrame, per_file: DataFrame) -> DataFrame:
    counts = per_file.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("chunk_count"),
        F.sum("stored").alias("vectors_upserted"))
    joined = repos.join(counts, "repo_id", "left")
    counters = ("file_count", "chunk_count", "vectors_upserted")
    empty = F.coalesce(F.col("file_count"), F.lit(0)) == 0
    return joined.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in counters},
        "status": F.when(empty, "failed").otherwise("ready"),
        "error": F.when(empty, NO_FILES),
    })


def summary_events(summary: DataFrame, seq: int = 0) -> DataFrame:
    """Life-cycle events that an ingestion emits, in order, for the event table or stream.

    Counters appear with ``embedding``; a repository without files goes from ``chunking`` to
    ``failed``.
    """
    failed = F.col("status") == "failed"

    def event(i: int, status: str, counted: bool = False, error: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(seq + i).cast("bigint").alias("seq"), F.lit(status).alias("status"),
            (F.col("file_count") if counted else none).cast("int").alias("file_count"),
            (F.col("chunk_count") if counted else none).cast("int").alias("chunk_count"),
            (none if error is None else error).cast("string").alias("error"))

    started = [event(1, "cloning"), event(2, "chunking")]
    events = F.when(failed, F.array(*started, event(3, "failed", error=F.col("error")))).otherwise(
        F.array(*started, event(3, "embedding", True), event(4, "ready", True)))
    return summary.select("repo_id", F.explode(events).alias("e")).select("repo_id", "e.*")
