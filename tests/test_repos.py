import pytest
from pyspark.sql import functions as F

from sourceloom.limits import Limits
from sourceloom.operators import repos
from sourceloom.operators.chunks import fallback_chunks, with_chunks
from sourceloom.sources import store, tree

EVENTS = ("repo_id string, seq long, ts timestamp, status string, url string, branch string, "
          "file_count int, chunk_count int, error string")


@pytest.mark.parametrize("url,clean,outcome", [
    ("https://github.com/o/r", "https://github.com/o/r", "accepted"),
    (" https://github.com/o/r.git/ \n", "https://github.com/o/r", "accepted"),
    ("https://github.com/o/r///", "https://github.com/o/r", "accepted"),
    ("https://github.com/o.x/r_-1.git", "https://github.com/o.x/r_-1", "accepted"),
    ("https://github.com/o", "https://github.com/o", "invalid"),
    ("http://github.com/o/r", "http://github.com/o/r", "invalid"),
    ("https://github.com/o/r/tree/main", "https://github.com/o/r/tree/main", "invalid"),
    (None, None, "invalid"),
])
def test_addresses(spark, url, clean, outcome):
    row = repos.repo_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert (row.clean_url, row.outcome) == (clean, outcome)


def test_display_name(spark):
    df = spark.createDataFrame([("https://github.com/o/r",), ("https://x.org/a",)], "u string")
    assert [r.n for r in df.select(repos.repo_name("u").alias("n")).collect()] == ["o/r", "https://x.org/a"]


def test_jobs(spark):
    rows = ['{"repo_id": "a", "github_url": "u"}', '{"repo_id": "a", "github_url": "u", "branch": null}',
            '{"repo_id": "a", "github_url": "u", "branch": "dev"}', '{"repo_id": "", "github_url": "u"}',
            '{"github_url": "u"}', "nonsense", "[]", None]
    messages = spark.createDataFrame([(r,) for r in rows], "value string")
    jobs = {(r.repo_id, r.branch) for r in repos.job_payloads(messages).collect()}
    assert jobs == {("a", "main"), ("a", "dev")}
    assert repos.decode_jobs(messages).where("outcome = 'dead_letter'").count() == 5


def test_latest_keeps_values_that_later_events_lack(spark):
    rows = [("r", 1, None, "queued", "u", "main", None, None, None),
            ("r", 2, None, "failed", None, None, None, None, "boom"),
            ("r", 3, None, "ready", None, None, 4, 9, None),
            ("s", 1, None, "queued", "v", "main", None, None, None)]
    out = {r.repo_id: r for r in repos.repo_latest(spark.createDataFrame(rows, EVENTS)).collect()}
    r = out["r"]
    assert (r.status, r.url, r.file_count, r.chunk_count, r.error) == ("ready", "u", 4, 9, "boom")
    assert out["s"].file_count is None


def test_list_has_true_total_and_known_states_only(spark):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("repo_id"),
        F.when(F.col("id") == 59, "odd").otherwise("ready").alias("status"),
        F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("created_at"))
    rows = repos.repo_list(df).collect()
    assert len(rows) == 50 and {(r.returned, r.total) for r in rows} == {(50, 59)}
    assert [r.repo_id for r in rows[:3]] == ["58", "56", "57"]


def test_new_repositories(spark):
    rows = repos.create_repos(spark.createDataFrame([("u", None), ("u", "dev")], "url string, branch string")).collect()
    assert {r.branch for r in rows} == {"main", "dev"} and len({r.repo_id for r in rows}) == 2
    assert {r.status for r in rows} == {"queued"}


def test_upsert(spark):
    schema = "id string, seq long, v string"
    base = spark.createDataFrame([("a", 0, "a0"), ("b", 0, "b0")], schema)
    # One key makes up nearly all of the delivery.
    incoming = spark.createDataFrame([("b", i, f"b{i}") for i in range(1, 50)] + [("c", 1, "c1")], schema)
    once = repos.upsert(base, incoming)
    want = {("a", 0, "a0"), ("b", 49, "b49"), ("c", 1, "c1")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in repos.upsert(once, incoming).collect()} == want


def files(spark, n=7):
    rows = [(f"r{i % 2}", f"f{i:02d}.py", "\n".join(f"w{i} {j}" for j in range(30)), "python") for i in range(n)]
    return spark.createDataFrame(rows, "repo_id string, path string, content string, language string")


def test_batches_number_chunks_across_files(spark):
    limits = Limits(window=4, stride=3, max_tokens=5, upsert_batch=10)
    chunked = with_chunks(files(spark), limits, boundaries=False)
    out = repos.upsert_batches(chunked, lambda c: ~c["content"].contains("w2 29"), limits).collect()
    got = {(r.repo_id, r.batch): (r.row_count, r.ok, r.upserted) for r in out}
    chunks = fallback_chunks(files(spark), limits).orderBy("repo_id", "file_path", "start_line").collect()
    want = {}
    for repo in ("r0", "r1"):
        mine = [c for c in chunks if c.repo_id == repo]
        for b in range(0, len(mine), 10):
            part = mine[b:b + 10]
            ok = all("w2 29" not in c.content for c in part)
            want[(repo, b // 10)] = (len(part), ok, len(part) if ok else 0)
    assert got == want and not all(v[1] for v in want.values())


def test_summary_and_its_events(spark):
    jobs = spark.createDataFrame([("r0", "u0"), ("r1", "u1"), ("empty", "u2")], "repo_id string, url string")
    summary = repos.ingest_summary(jobs, with_chunks(files(spark)))
    out = {r.repo_id: (r.file_count, r.chunk_count, r.status) for r in summary.collect()}
    assert out == {"r0": (4, 4, "ready"), "r1": (3, 3, "ready"), "empty": (0, 0, "failed")}
    events = repos.summary_events(summary).collect()
    states = {}
    for e in sorted(events, key=lambda e: e.seq):
        states.setdefault(e.repo_id, []).append(e.status)
    assert states["r0"] == ["cloning", "chunking", "embedding", "ready"]
    assert states["empty"] == ["cloning", "chunking", "failed"]


def test_store_merge_is_idempotent_and_touches_only_its_repositories(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path) is None
    first = fallback_chunks(files(spark)).withColumn("seq", F.lit(1).cast("long"))
    store.upsert_store(spark, first, path)
    store.upsert_store(spark, first, path)
    assert store.read_store(spark, path).count() == 7
    before = set((tmp_path / "store" / "chunks" / "repo_id=r1").iterdir())
    change = first.where("repo_id = 'r0'").withColumn("seq", F.lit(2).cast("long")).withColumn(
        "content", F.lit("new"))
    store.upsert_store(spark, change, path)
    rows = store.read_store(spark, path).collect()
    assert sorted(r.content == "new" for r in rows) == [False] * 3 + [True] * 4
    assert set((tmp_path / "store" / "chunks" / "repo_id=r1").iterdir()) == before


def test_store_delete_hides_all_rows_until_they_are_written_again(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = fallback_chunks(files(spark)).withColumn("seq", F.lit(1).cast("long"))
    store.upsert_store(spark, rows, path)
    store.delete_from_store(spark.createDataFrame([("r0", 5)], "repo_id string, seq long"), path)
    assert {r.repo_id for r in store.read_store(spark, path).collect()} == {"r1"}
    again = rows.where("repo_id = 'r0'").withColumn("seq", F.lit(6).cast("long"))
    store.upsert_store(spark, again, path)
    assert store.read_store(spark, path).count() == 7


def test_store_reads_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    store.upsert_store(spark, fallback_chunks(files(spark)).withColumn("seq", F.lit(1).cast("long")), path)
    df = spark.read.parquet(f"{path}/chunks").where("repo_id = 'r0'").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan and "ReadSchema: struct<id:string>" in plan


def test_result_writers(spark, tmp_path):
    scores = spark.createDataFrame([("alpha", "recall", 0.5)], "provider string, metric string, value double")
    results = spark.createDataFrame([("alpha", "q", "a")], "provider string, question string, answer string")
    for _ in range(2):
        store.write_eval_run(results, scores, str(tmp_path / "eval"), "20240101_000000")
    assert spark.read.json(str(tmp_path / "eval" / "scores")).collect()[0].value == 0.5
    assert spark.read.json(str(tmp_path / "eval" / "results")).count() == 1
    store.write_ingest_summary(results, str(tmp_path / "summary"), "x")
    store.write_traces(results, str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 1
    (tmp_path / "pairs.json").write_text('[{"question": "q",\n "ground_truth": "g"}, {"question": "p"}]')
    rows = tree.read_eval_pairs(spark, str(tmp_path / "pairs.json")).collect()
    assert [(r.question, r.ground_truth) for r in rows] == [("q", "g"), ("p", None)]


def test_run_stamp_and_durations(spark):
    df = spark.createDataFrame([("2024-03-01 10:20:30.250", "2024-03-01 10:20:31.75")], "a string, b string").selectExpr(
        "timestamp(a) a", "timestamp(b) b")
    row = df.select(repos.run_stamp(F.col("a")).alias("s"), repos.elapsed_ms("a", "b").alias("ms")).first()
    assert (row.s, row.ms) == ("20240301_102030", 1500)
    rows = [("r", "cloning", 10), ("r", "ready", 25), ("run", "cloning", 3), ("bad", "cloning", 5), ("bad", "failed", 6),
            ("bad", "cloning", 9), ("bad", "ready", 12), ("odd", "ready", 4)]
    events = spark.createDataFrame(rows, "repo_id string, status string, at int").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.repo_id: r.duration_seconds for r in repos.job_durations(events).collect()}
    assert got == {"r": 15.0, "run": None, "bad": 7.0, "odd": None}


def test_usage_sketches_merge_and_keep_their_error(spark):
    import random

    from sourceloom.operators import traces

    rng = random.Random(1)
    rows = [(f"m{i % 2}/x", d, int(rng.lognormvariate(7, 2)), i) for i in range(4000) for d in (i % 3,)]
    df = spark.createDataFrame(rows, "model string, day int, latency_ms long, k long").withColumn(
        "usage", F.struct(F.col("k").alias("input"), (F.col("k") % 7).alias("output"), F.col("k").alias("total")))
    daily = traces.usage_sketches(df, "model", "day")
    merged = traces.merge_usage(daily, "model")
    assert daily.count() < 3 * 2 * 500 and merged.groupBy("model").count().agg(F.max("count")).first()[0] < 128 + 64 * 20
    whole = {r.model: r for r in traces.usage_by_model(df).collect()}
    assert {r.model: r for r in traces.sketch_usage(merged).collect()} == whole
    for model in ("m0/x", "m1/x"):
        values = sorted(r[2] for r in rows if r[0] == model)
        assert whole[model].requests == 2000 and whole[model].avg_latency_ms == sum(values) / 2000
        assert abs(whole[model].median_latency_ms / ((values[999] + values[1000]) / 2) - 1) <= 1 / 128 + 1e-9
    edges = [0, 1, 127, 128, 129, 255, 256, 2**40 + 12345, 2**62]
    buckets = spark.createDataFrame([(v,) for v in edges], "v long").select("v", traces.latency_bucket("v").alias("b")).collect()
    assert all(r.b == r.v for r in buckets if r.v < 128) and all(abs(r.b - r.v) * 128 <= r.v for r in buckets)
