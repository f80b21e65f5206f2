import json
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sourceloom.functions.text import token_count
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.repos import repo_latest
from sourceloom.sources.store import read_store
from sourceloom.streaming import jobs

FILES = [(f"r{i % 3}", f"src/f{i}.py", 20, f"word{i} and more text", ) for i in range(9)]


def write(folder, name, messages):
    folder.mkdir(exist_ok=True)
    text = "\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages)
    (folder / name).write_text(text + "\n")


@pytest.fixture
def name():
    """A stream of its own below the checkpoint folder, which the session may share between runs."""
    return f"stream_{uuid.uuid4().hex}"


def ingest(spark, tmp_path, name, on_status=None):
    files = spark.createDataFrame(FILES, "repo_id string, path string, size long, content string")
    stream = jobs.job_stream(jobs.message_stream(spark, str(tmp_path / "in")))
    query = jobs.run_jobs(stream, files, str(tmp_path / "store"), str(tmp_path / "events"),
                          checkpoint=str(tmp_path / "checkpoint"), on_status=on_status, name=name)
    query.awaitTermination(300)
    assert query.exception() is None


def state(spark, tmp_path):
    events = spark.read.parquet(str(tmp_path / "events"))
    return {r.repo_id: r.status for r in repo_latest(events).collect()}


def test_jobs_are_ingested_once_and_status_hook_errors_are_ignored(spark, tmp_path, name):
    job = {"repo_id": "r0", "github_url": "u0"}
    write(tmp_path / "in", "1.json", [job, job, {"repo_id": "none", "github_url": "u"}, "broken"])
    seen = []

    def hook(df):
        seen.append({r.status for r in df.collect()})
        raise RuntimeError("hook")

    ingest(spark, tmp_path, name, hook)
    assert state(spark, tmp_path) == {"r0": "ready", "none": "failed"}
    # One call for each phase, when it is reached.
    assert seen == [{"queued"}, {"cloning"}, {"chunking"}, {"failed"}, {"embedding"}, {"ready"}]
    assert read_store(spark, str(tmp_path / "store")).count() == 3
    events = spark.read.parquet(str(tmp_path / "events")).count()

    write(tmp_path / "in", "2.json", [job])                                  # redelivery
    ingest(spark, tmp_path, name)
    assert read_store(spark, str(tmp_path / "store")).count() == 3
    assert spark.read.parquet(str(tmp_path / "events")).count() == events

    write(tmp_path / "in", "3.json", [{"repo_id": "r1", "github_url": "u1", "branch": "dev"}])
    ingest(spark, tmp_path, name)
    assert state(spark, tmp_path) == {"r0": "ready", "none": "failed", "r1": "ready"}
    assert read_store(spark, str(tmp_path / "store")).count() == 6


def retrying(spark, tmp_path, name, files, on_status=None, limits=DEFAULTS):
    messages = jobs.message_stream(spark, str(tmp_path / "in"))
    stream = jobs.attempt_stream(messages, jobs.outcome_stream(spark, str(tmp_path / "outcomes")))
    query = jobs.run_jobs(stream, files, str(tmp_path / "store"), str(tmp_path / "events"),
                          checkpoint=str(tmp_path / "checkpoint"), limits=limits, on_status=on_status, name=name,
                          outcomes=str(tmp_path / "outcomes"), dead_letters=str(tmp_path / "dead"))
    query.awaitTermination(300)
    assert query.exception() is None


def test_a_job_that_always_fails_is_given_up_and_the_stream_goes_on(spark, tmp_path, name):
    rows = [(r, p, n, "BROKEN" if r == "r1" else c) for r, p, n, c in FILES]
    files = spark.createDataFrame(rows, "repo_id string, path string, size long, content string")
    limits = Limits(count_tokens=lambda text: F.when(
        text.contains("BROKEN"), F.raise_error(F.lit("cannot be read")).cast("int")).otherwise(token_count(text)))
    write(tmp_path / "in", "1.json", [{"repo_id": r, "github_url": f"u{r}"} for r in ("r0", "r1", "r2")])
    for run in range(5):
        retrying(spark, tmp_path, name, files, limits=limits)
        if run == 1:                                                         # redelivered while it is tried again
            write(tmp_path / "in", "2.json", [{"repo_id": "r1", "github_url": "ur1"}, {"repo_id": "r0", "github_url": "ur0"}])
    assert state(spark, tmp_path) == {"r0": "ready", "r1": "failed", "r2": "ready"}
    events = spark.read.parquet(str(tmp_path / "events"))
    tries = events.where("repo_id = 'r1' and status = 'failed'").collect()
    assert len(tries) == 3 and all("cannot be read" in t.error for t in tries)
    dead = spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "dead")).collect()
    assert [(d.repo_id, d.attempt) for d in dead] == [("r1", 3)] and "cannot be read" in dead[0].error
    assert events.where("repo_id = 'r0' and status = 'ready'").count() == 1
    assert {r.repo_id for r in read_store(spark, str(tmp_path / "store")).select("repo_id").distinct().collect()} == {"r0", "r2"}

    write(tmp_path / "in", "3.json", [{"repo_id": "none", "github_url": "u"}])   # the stream still takes jobs
    retrying(spark, tmp_path, name, files, limits=limits)
    retrying(spark, tmp_path, name, files, limits=limits)
    assert state(spark, tmp_path)["none"] == "failed"
    outcomes = spark.read.parquet(str(tmp_path / "outcomes"))
    assert {(r.repo_id, r.attempt, r.kind) for r in outcomes.collect()} == {
        ("r0", 1, "done"), ("r2", 1, "done"), ("none", 1, "done"), ("r1", 1, "failed"), ("r1", 2, "failed"), ("r1", 3, "failed")}


def test_a_job_that_fails_once_is_ready_after_its_second_attempt(spark, tmp_path, name):
    rows = spark.createDataFrame(FILES, "repo_id string, path string, size long, content string")
    write(tmp_path / "in", "1.json", [{"repo_id": "r0", "github_url": "u"}])
    retrying(spark, tmp_path, name, rows.withColumn("content", F.raise_error(F.lit("down"))))
    assert state(spark, tmp_path) == {"r0": "failed"}
    retrying(spark, tmp_path, name, rows)
    retrying(spark, tmp_path, name, rows)
    assert state(spark, tmp_path) == {"r0": "ready"}
    assert not list((tmp_path / "dead").rglob("part-*.json")) or not spark.read.option(
        "recursiveFileLookup", "true").text(str(tmp_path / "dead")).count()


def test_a_reader_sees_every_phase_before_the_next(spark, tmp_path, name):
    write(tmp_path / "in", "1.json", [{"repo_id": "r0", "github_url": "u0"}, {"repo_id": "none", "github_url": "u"}])
    ingest(spark, tmp_path, name)
    schema = spark.read.parquet(str(tmp_path / "events")).drop("run", "batch", "step").schema
    stream = jobs.event_stream(spark, str(tmp_path / "events"), schema, max_files=1)
    seen = {}

    def watch(rows):
        for r in rows.collect():
            seen.setdefault(r.repo_id, []).append((r.status, r.chunk_count, r.error))

    jobs.watch_status(stream, watch, str(tmp_path / "checkpoint"), f"{name}_status").awaitTermination(300)
    assert [s[0] for s in seen["r0"]] == ["queued", "cloning", "chunking", "embedding", "ready"]
    assert [s[1] for s in seen["r0"]] == [None, None, None, 3, 3]
    assert [s[0] for s in seen["none"]] == ["queued", "cloning", "chunking", "failed"] and seen["none"][-1][2]


def test_a_fresh_checkpoint_keeps_earlier_events_and_numbers_later_ones_higher(spark, tmp_path, name):
    write(tmp_path / "in", "1.json", [{"repo_id": "r0", "github_url": "u0"}])
    ingest(spark, tmp_path, name)
    first = spark.read.parquet(str(tmp_path / "events")).agg(F.max("seq"), F.count("*")).first()
    ingest(spark, tmp_path, f"{name}_fresh")
    events = spark.read.parquet(str(tmp_path / "events"))
    assert events.count() == 2 * first[1] and events.where(F.col("seq") > first[0]).count() == first[1]


def test_dead_letters(spark, tmp_path, name):
    write(tmp_path / "in", "1.json", ["broken", {"repo_id": "r", "github_url": "u"}, {"repo_id": "r"}])
    messages = jobs.message_stream(spark, str(tmp_path / "in"))
    for _ in range(2):                                                       # a restart adds nothing
        jobs.write_dead_letters(messages, str(tmp_path / "dead"), str(tmp_path / "checkpoint"),
                                name).awaitTermination(300)
    assert spark.read.json(str(tmp_path / "dead")).count() == 2


def test_status_stream_equals_batch(spark, tmp_path, sf_dir):
    from suite import corpus

    events = corpus.repo_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4, "seq").write.parquet(str(tmp_path / "events"))
    stream = jobs.event_stream(spark, str(tmp_path / "events"), events.schema)
    query = (jobs.status_stream(stream).writeStream.format("memory").queryName("status_now")
             .outputMode("complete").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    got = {tuple(r) for r in spark.table("status_now").collect()}
    assert got == {tuple(r) for r in repo_latest(events).collect()} and got


def test_checkpoint_folder_comes_from_the_session():
    def session(value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value or default))

    assert jobs._checkpoint(session("/shared"), "/given", "x") == "/shared/x"
    assert jobs._checkpoint(session(None), "/given", "x") == "/given/x"
    with pytest.raises(ValueError):
        jobs._checkpoint(session(None), None, "x")
