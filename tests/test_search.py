import math
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.functions.vector import features, sparse_cosine
from sourceloom.operators import quality, retrieve, search, vectors

WORDS = re.compile(r"\w+")


def bag(text):
    return Counter(int(md5(w.encode()).hexdigest()[:8], 16) % 1024 for w in WORDS.findall(text.lower()))


def cosine(a, b):
    dot = sum(n * b.get(k, 0) for k, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


@pytest.mark.parametrize("text", ["", "...", "a", "A a b", "the cat and the dog and the cat", "été Ünï x_1"])
def test_features_equal_a_plain_count(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(features("t").alias("f")).first().f
    assert dict(zip(row.buckets, row.tfs)) == bag(text)
    assert row.buckets == sorted(row.buckets)


def test_cosine(spark):
    df = spark.createDataFrame([("a b b", "b c"), ("a", ""), ("x", "y")], "l string, r string")
    got = [r.s for r in df.select(sparse_cosine(features("l"), features("r")).alias("s")).collect()]
    assert got == pytest.approx([cosine(bag("a b b"), bag("b c")), 0.0, 0.0])


def corpus(spark, n=300, hot=0.7):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        repo = "hot" if rng.random() < hot else f"r{i % 5}"
        text = " ".join(rng.choice(vocabulary, rng.integers(1, 12)))
        rows.append((f"c{i:04d}", repo, "same copy text" if i % 3 == 0 else text))
    questions = [(i, "hot" if i % 2 else f"r{i % 7}", " ".join(rng.choice(vocabulary, 4)) +
                  (" copy" if i % 4 == 0 else ""), 1 + i % 12) for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, repo_id string, content string")
    asked = spark.createDataFrame(questions, "question_id int, repo_id string, question string, top_k int")
    return rows, questions, chunks, asked


def brute_force(rows, questions):
    out = set()
    for qid, repo, question, top_k in questions:
        q = bag(question)
        scored = [(-cosine(q, bag(t)), i) for i, r, t in rows if r == repo]
        best = sorted(s for s in scored if s[0] < 0)[:min(2 * top_k, 20)]
        out |= {(qid, rank + 1, i, round(-s, 12)) for rank, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("vector_block,question_block", [(4096, 512), (16, 4), (1, 1)])
def test_block_search_equals_brute_force(spark, monkeypatch, vector_block, question_block):
    """A hot repository is cut into many blocks; a third of all rows are equal copies."""
    monkeypatch.setattr(search, "VECTOR_BLOCK", vector_block)
    monkeypatch.setattr(search, "QUESTION_BLOCK", question_block)
    rows, questions, chunks, asked = corpus(spark, n=300 if vector_block > 1 else 60)
    v = vectors.sparse_vectors(chunks, F.col("content"), ["id", "repo_id"])
    hits = search.search_sparse(v, retrieve.with_question_vectors(asked))
    got = {(r.question_id, r.rank, r.id, round(r.score, 12)) for r in hits.collect()}
    assert got == brute_force(rows, questions)


def test_search_without_broadcast(spark):
    rows, questions, chunks, asked = corpus(spark, n=80)
    v = vectors.sparse_vectors(chunks, F.col("content"), ["id", "repo_id"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = search.search_sparse(v, retrieve.with_question_vectors(asked))
        assert {(r.question_id, r.rank, r.id, round(r.score, 12)) for r in hits.collect()} == brute_force(
            rows, questions)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_search_shuffles_no_vectors_and_runs_no_job_while_planned(spark, tmp_path):
    """Written tables, as a store has them: their sizes are known, so the questions are what is sent."""
    _, _, chunks, asked = corpus(spark, n=200)
    vectors.sparse_vectors(chunks, F.col("content"), ["id", "repo_id"]).write.parquet(str(tmp_path / "v"))
    asked.write.parquet(str(tmp_path / "q"))
    v, q = spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "q"))
    spark.sparkContext.setJobGroup("planning", "a search that is only planned")
    hits = search.search_sparse(v, retrieve.with_question_vectors(q))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    below_join = plan[plan.index("BroadcastHashJoin"):]
    assert "Exchange hashpartitioning" not in below_join and "SortMergeJoin" not in plan


def test_tiles_hold_every_row_once(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("k"), "id",
                                  F.array("id", "id").alias("v")).repartition(3)
    rows = search.tiles(df, ["k"], 50, ["id"], "_t").collect()
    assert all(len(r.id_t) <= 50 and r.id_t == sorted(r.id_t) and r.v_t == [[i, i] for i in r.id_t] for r in rows)
    assert sorted((r.k, i) for r in rows for i in r.id_t) == sorted((r.k, r.id) for r in df.where("k is not null").collect())


def dense_input(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 8)).astype("float32")
    data[200:] = data[:200] + rng.normal(scale=0.05, size=(200, 8)).astype("float32")
    v = spark.createDataFrame([(i, f"s{i % 2}", x.tolist()) for i, x in enumerate(data)],
                              "id long, repo_id string, vector array<float>")
    q = spark.createDataFrame([(i, f"s{i % 2}", data[i].tolist(), 5) for i in range(0, 60)],
                              "question_id long, repo_id string, vector array<float>, fetch_k int")
    return data.astype(float), v, q


def test_dense_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 50)
    data, v, q = dense_input(spark)
    got = {}
    for r in search.search_dense(v, q).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.id))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for i in range(60):
        ids = np.arange(i % 2, 400, 2)
        scores = np.round(unit[ids] @ unit[i], 4)
        best = ids[np.lexsort((ids, -scores))][:5]
        assert [x for _, x in sorted(got[i])] == best.tolist()


def neighbourhoods(spark, count=4000, dims=32):
    """Two repositories of groups of near vectors; a question asks for the neighbours of a vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(count // 10, dims))
    data = (centres[np.arange(count) // 2 % len(centres)] + rng.normal(scale=0.35, size=(count, dims))).astype("float32")
    v = spark.createDataFrame([(i, f"s{i % 2}", x.tolist()) for i, x in enumerate(data)],
                              "id long, repo_id string, vector array<float>")
    q = spark.createDataFrame([(i, f"s{i % 2}", data[i].tolist(), 5) for i in range(0, 80)],
                              "question_id long, repo_id string, vector array<float>, fetch_k int")
    return v, q


def test_lsh_recall_and_share_of_pairs(spark):
    v, q = neighbourhoods(spark)
    bits = search.lsh_bits(2000)
    exact = search.search_dense(v, q)
    found = search.search_lsh(v, q, dims=32, bits=bits)
    assert found.groupBy("question_id", "id").count().where("count > 1").count() == 0
    assert quality.recall_at_k(found, exact).first().recall >= 0.9
    pairs = search.lsh_candidates(search.lsh_index(v, 32, 8, bits), search.lsh_probes(q, 32, 8, bits, 1))
    assert 0 < pairs.count() < 0.2 * 80 * 2000


def test_lsh_more_flips_find_more_and_scores_are_exact(spark):
    v, q = neighbourhoods(spark, 800)
    exact = {(r.question_id, r.id): r.score for r in search.search_dense(v, q.withColumn("fetch_k", F.lit(20))).collect()}
    recalls = []
    for flips in (0, 1, 2):
        found = search.search_lsh(v, q, dims=32, bits=6, tables=2, flips=flips).collect()
        assert all(exact.get((r.question_id, r.id), r.score) == r.score for r in found)
        recalls.append(len({(r.question_id, r.id) for r in found} & set(exact)))
    assert recalls == sorted(recalls) and recalls[0] < recalls[2]


def test_lsh_bits_grow_with_rows():
    assert [search.lsh_bits(n) for n in (0, 1, 32, 2000, 1_000_000, 10**15)] == [1, 1, 4, 10, 19, 24]


def test_lsh_index_holds_no_vectors_and_zero_vectors_are_no_hits(spark):
    v, q = neighbourhoods(spark, 100)
    assert search.lsh_index(v, 32, 2, 3).columns == ["repo_id", "lsh_table", "lsh_bucket", "id"]
    zero = spark.createDataFrame([(9999, "s0", [0.0] * 32)], v.schema)
    assert search.search_lsh(v.union(zero), q, dims=32, bits=1, flips=1).where("id = 9999").count() == 0


def test_over_fetch(spark):
    df = spark.createDataFrame([(1,), (8,), (10,), (20,)], "k int")
    assert [r.f for r in df.select(search.fetch_k("k").alias("f")).collect()] == [2, 16, 20, 20]


def test_search_plan_limits_before_shuffling_and_pairs_nothing(spark):
    _, _, chunks, asked = corpus(spark, n=20)
    v = vectors.sparse_vectors(chunks, F.col("content"), ["id", "repo_id"])
    hits = search.search_sparse(v, retrieve.with_question_vectors(asked))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_registered_lsh_scores_all_of_its_buckets(spark, tmp_path):
    from suite import corpus
    from suite.queries import search_lsh

    data = np.random.default_rng(8).normal(size=(1200, 64)).astype("float32")
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(data)],
                          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    planes = np.array(search.hyperplanes(64, 24), float).reshape(8, 3, 64)

    def buckets(x):
        return (np.einsum("tbd,nd->ntb", planes, x) >= 0) @ (1 << np.arange(3))

    asked = {r.question_id: (r.repo_id, np.array(r.vector)) for r in corpus.centroids(spark, str(tmp_path)).collect()}
    wanted = set()
    for name, (repo, vector) in asked.items():
        ids = np.arange(int(repo[3:]), 1200, 4)
        ids = ids[(buckets(data[ids].astype(float)) == buckets(vector[None])).any(axis=1)]
        part = data[ids].astype(float)
        scores = np.round(part @ vector / np.sqrt((part * part).sum(axis=1) * (vector @ vector)), 4)
        wanted |= {(name, int(i)) for i in ids[np.lexsort((ids, -scores))][:20]}
    assert {(r.question_id, r.id) for r in search_lsh(spark, str(tmp_path)).collect()} == wanted


def test_tiles_reach_the_workers_in_small_batches(spark, tmp_path, monkeypatch):
    from sourceloom.plans import ask
    from sourceloom.sources import staging

    def sizes(kind, dims, digits):
        def score(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_pydict({"question_id": [0], "fetch_k": pa.array([20], pa.int32()),
                                                  "repo_id": ["r"], "id": [0], "score": [float(batch.nbytes)]})
        return score

    # 24 MB of vectors in one task.
    whole = "transform(sequence(0, 1023), x -> cast(x as int))"
    v = spark.range(0, 3000, 1, 1).selectExpr("id", "'r' repo_id", f"{whole} buckets", f"{whole} tfs", "1L norm2")
    asked = spark.createDataFrame([(0, "r", "a word", 10)], "question_id long, repo_id string, question string, top_k int")
    monkeypatch.setattr(search, "_tile_scorer", sizes)
    monkeypatch.setattr(staging, "checkpoint_dir", lambda spark, fallback=None: str(tmp_path))
    before = spark.conf.get(staging.BATCH_KEY, None)
    hits = ask.find_hits(v, asked)
    assert spark.conf.get(staging.BATCH_KEY, None) == before
    largest = hits.agg(F.max("score")).first()[0]
    assert 1 << 20 < largest < 10 << 20
