import pytest

from sourceloom.operators import retrieve, traces
from sourceloom.plans import ask

HITS = ("question_id int, repo_id string, rank int, score double, id string, file_path string, "
        "start_line int, end_line int")


def kept(spark, *ranges, path="a.py"):
    rows = [(1, "r", i + 1, 1.0 - i / 100, f"c{i}", path if isinstance(path, str) else path[i], s, e)
            for i, (s, e) in enumerate(ranges)]
    out = retrieve.overlap_dedup(spark.createDataFrame(rows, HITS)).orderBy("rank").collect()
    assert [r.rank for r in out] == list(range(1, len(out) + 1))
    return [r.id for r in out]


def test_overlap_is_inclusive(spark):
    assert kept(spark, (1, 10), (10, 20)) == ["c0"]
    assert kept(spark, (1, 10), (11, 20)) == ["c0", "c1"]
    assert kept(spark, (10, 20), (1, 9), (5, 12), (20, 20)) == ["c0", "c1"]


def test_a_removed_hit_removes_nothing(spark):
    # b overlaps a and c overlaps b, but c does not overlap a.
    assert kept(spark, (1, 10), (8, 15), (14, 20)) == ["c0", "c2"]


def test_other_files_do_not_overlap(spark):
    assert kept(spark, (1, 10), (1, 10), path=["a.py", "b.py"]) == ["c0", "c1"]


def test_sources_are_trimmed_typed_and_defaulted(spark):
    schema = HITS.replace("start_line int", "start_line string") + (
        ", node_type string, node_name string, language string, content string")
    rows = [(1, "r", 1, 0.9, "a", "a.py", "1", 5, "function", "f", "python", "x"),
            (1, "r", 2, 0.8, "b", "b.py", "bad", 5, None, None, None, None),
            (1, "r", 3, 0.7, "c", "c.py", None, 5, None, None, None, None)]
    hits = spark.createDataFrame(rows, schema)
    typed = retrieve.to_sources(hits).collect()
    assert [(r.id, r.start_line, r.node_type, r.content) for r in typed] == [
        ("a", 1, "function", "x"), ("c", 0, "unknown", "")]
    questions = spark.createDataFrame([(1, 1)], "question_id int, top_k int")
    ints = hits.where("id = 'a'").withColumn("start_line", hits.start_line.cast("int"))
    assert retrieve.rag_sources(ints, questions).count() == 1


def test_prompt(spark):
    questions = spark.createDataFrame([(1, "r", "o/r", "Why?"), (2, "r", "o/r", "How?")],
                                      "question_id int, repo_id string, repo_name string, question string")
    sources = spark.createDataFrame(
        [(1, 2, "b.go", "type", "B", 3, 4, "go", "bb", 0.5), (1, 1, "a.py", "function", "f", 1, 2, "python", "aa", 0.9)],
        "question_id int, rank int, file_path string, node_type string, node_name string, start_line int, "
        "end_line int, language string, content string, score double")
    rows = {r.question_id: r for r in retrieve.prompts(questions, sources).collect()}
    assert rows[1].source_count == 2 and rows[2].source_count == 0
    assert rows[1].messages[0].role == "system" and rows[1].messages[1].role == "user"
    assert rows[1].messages[1].content == (
        "Repository: o/r\n\n## Retrieved Code Context\n\n"
        "## [1] a.py:L1-L2 (python function: f)\n```python\naa\n```\n\n"
        "## [2] b.go:L3-L4 (go type: B)\n```go\nbb\n```\n\n## Question\n\nWhy?\n\n"
        "Please answer the question using the code context above. Cite sources for all specific claims.")
    assert "(No relevant code context found)" in rows[2].messages[1].content


def test_gate(spark):
    questions = spark.createDataFrame(
        [(1, "ok", 8), (2, "ok", None), (3, "ok", 0), (4, "ok", 21), (5, "busy", 8), (6, "none", 8), (7, "ok", 20)],
        "question_id int, repo_id string, top_k int")
    repos = spark.createDataFrame([("ok", "ready"), ("busy", "chunking")], "repo_id string, status string")
    hits = spark.createDataFrame([(1, "c"), (2, "c"), (5, "c")], "question_id int, id string")
    out = {r.question_id: (r.outcome, r.top_k) for r in retrieve.query_gate(questions, repos, hits).collect()}
    assert out == {1: ("ok", 8), 2: ("ok", 8), 3: ("invalid", 0), 4: ("invalid", 21), 5: ("not_ready", 8),
                   6: ("not_found", 8), 7: ("no_results", 20)}


def test_question_to_source_end_to_end(spark):
    from sourceloom.operators.chunks import fallback_chunks

    files = spark.createDataFrame(
        [("r", "a.py", "alpha beta gamma", "python"), ("r", "b.py", "delta epsilon", "python"),
         ("s", "a.py", "alpha beta gamma", "python")], "repo_id string, path string, content string, language string")
    questions = spark.createDataFrame([(1, "r", "where is gamma alpha", 2)],
                                      "question_id int, repo_id string, question string, top_k int")
    out = ask.answer_sources(fallback_chunks(files), questions).collect()
    assert [(r.repo_id, r.file_path, r.rank) for r in out] == [("r", "a.py", 1)]


def test_top_k_is_filled_in_and_bounded(spark):
    questions = spark.createDataFrame([(1, None), (2, 0), (3, 21), (4, 20)], "question_id int, top_k int")
    rows = retrieve.with_bounds(questions).orderBy("question_id").collect()
    assert [(r.question_id, r.top_k) for r in rows] == [(1, 8), (4, 20)]


def test_traces(spark):
    answers = spark.createDataFrame(
        [("t", "r", "q", ["x" * 400, "y" * 400, "z", "w"], "a", "alpha/small", 8, 5, None, 2, 3)],
        "trace_id string, repo_id string, question string, contents array<string>, answer string, model string, "
        "top_k int, latency_ms long, prompt_tokens int, completion_tokens int, total_tokens int")
    row = traces.query_traces(answers).first()
    assert row.generation_input == "Q: q\nContext: " + ("x" * 300 + "\n\n" + "y" * 300)[:500] + "..."
    assert row.tags == ["query", "alpha"] and row.chunks_retrieved == 4
    assert (row.usage.input, row.usage.output, row.usage.total) == (0, 2, 3)


def test_hits_join_with_and_without_broadcast(spark, monkeypatch):
    hits = spark.createDataFrame([(1, "r", 1, 0.5, "a")],
                                 "question_id int, repo_id string, rank int, score double, id string")
    metadata = spark.createDataFrame([("r", "a", "x"), ("s", "a", "y"), ("r", "b", "z")],
                                     "repo_id string, id string, content string")
    questions = spark.createDataFrame([(1,)], "question_id int")
    few = retrieve.hits_with_metadata(hits, metadata, questions)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieve, "MAX_BROADCAST_HITS", 0)
    many = retrieve.hits_with_metadata(hits, metadata, questions)
    assert few.collect() == many.collect() and few.first().content == "x"


def stored(spark):
    from pyspark.sql import functions as F

    from sourceloom.operators.vectors import FOLDED_COUNTS
    from sourceloom.plans import ingest

    rows = [(f"c{i}", "r" if i < 8 else "s", f"f{i}.py", f"word{i % 3} common text{i}") for i in range(10)]
    chunks = spark.createDataFrame(rows, "id string, repo_id string, file_path string, content string").withColumns({
        "language": F.lit("python"), "node_type": F.lit("module"), "node_name": F.lit("n"), "start_line": F.lit(1),
        "end_line": F.lit(2), "token_count": F.lit(3), "context_header": F.lit("")})
    both = ingest.vector_rows(chunks).unionByName(ingest.vector_rows(chunks, FOLDED_COUNTS), allowMissingColumns=True)
    asked = spark.createDataFrame([(1, "r", "word1 common", 3), (2, "s", "text9", 2), (3, "t", "common", 2), (4, "r", "common", 99)],
                                  "question_id int, repo_id string, question string, top_k int")
    return both, asked


def test_two_encoders_share_a_store_and_a_search_sees_its_own(spark):
    from sourceloom.operators.vectors import FOLDED_COUNTS

    both, asked = stored(spark)
    assert {r.encoder: r["count"] for r in both.groupBy("encoder").count().collect()} == {
        "word-counts-1024": 10, "folded-counts-64": 10}
    sparse = ask.answer_sources(both, asked).collect()
    dense = ask.answer_sources(both, asked, encoder=FOLDED_COUNTS).collect()
    for found in (sparse, dense):
        assert len({(r.question_id, r.id) for r in found}) == len(found)
        assert {(r.question_id, r.repo_id) for r in found} <= {(1, "r"), (2, "s")}
        best = {r.question_id: r.id for r in found if r.rank == 1}
        assert best[1] in ("c1", "c4", "c7") and best[2] == "c9"
    assert {r.rank for r in dense if r.question_id == 1} == {1, 2, 3}


def test_a_pandas_udf_can_be_the_encoder(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from sourceloom.operators.vectors import Encoder
    from sourceloom.plans import ingest

    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(t.count("o")), float(t.count("e")), 1.0])

    own = Encoder("letters", "dense", lengths)
    both, asked = stored(spark)
    rows = ingest.vector_rows(both.where("encoder = 'word-counts-1024'").drop("encoder", "buckets", "tfs", "norm2", "vector"), own)
    found = ask.answer_sources(rows, asked, encoder=own).collect()
    assert {r.question_id for r in found} == {1, 2}
    with pytest.raises(ValueError):
        ask.answer_sources(rows, asked)                          # no vectors of the default encoder


def test_unknown_kind_of_vectors():
    from sourceloom.operators.vectors import Encoder

    with pytest.raises(ValueError):
        Encoder("x", "other", lambda t: t)


def test_only_questions_that_pass_the_gate_are_searched(spark):
    both, asked = stored(spark)
    repos = spark.createDataFrame([("r", "https://github.com/o/r", "ready"), ("s", "https://github.com/o/s", "chunking")],
                                  "repo_id string, url string, status string")
    assert {r.question_id for r in ask.question_prompts(both, asked, repos).collect()} == {1}
    assert {r.question_id for r in ask.answer_sources(both, asked, repos=repos).collect()} == {1}
    got = {r.question_id: (r.outcome, r.hit_count > 0) for r in ask.question_outcomes(both, asked, repos).collect()}
    assert got == {1: ("ok", True), 2: ("not_ready", False), 3: ("not_found", False), 4: ("invalid", False)}


def tables(spark, path, questions):
    """Documents of two sources, and events after which src1 is ready, src2 waits and src3 is unknown."""
    docs = [(i, f"word{i} common text", "en", f"src{i % 2 + 1}", 17) for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    events = [(1, 1, "click"), (2, 2, "click"), (3, 1, "purchase")]
    spark.createDataFrame([(*e, 1.0, '{"k": 1}') for e in events],
                          "event_id long, user_id long, event_type string, value double, props string").selectExpr(
        "*", "timestamp'2026-01-01' ts").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_registered_prompts_ask_every_repository(spark, tmp_path):
    from suite.queries import prompts

    path = tables(spark, tmp_path, [(21, "word1 common"), (22, "word2 common"), (23, "common")])
    got = {r.question_id: (r.repo_id, r.source_count > 0, "github.com" in r.message or "org/" in r.message)
           for r in prompts(spark, path).collect()}
    assert got == {21: ("src1", True, True), 22: ("src2", True, True), 23: ("src3", False, False)}


def test_registered_gate_searches_every_question(spark, tmp_path):
    from suite.queries import query_gate

    path = tables(spark, tmp_path, [(1, "word1 common"), (32, "word2 common"), (3, "common"), (23 * 30 + 1, "common"),
                                    (22 * 30 + 1, "common"), (7 * 30 + 1, "common")])
    got = {r.question_id: (r.top_k, r.outcome, r.hit_count) for r in query_gate(spark, path).collect()}
    assert got == {1: (1, "ok", 2), 32: (9, "not_ready", 4), 3: (3, "not_found", 0), 691: (1, "ok", 2),
                   661: (17, "ok", 4), 211: (4, "ok", 4)}
