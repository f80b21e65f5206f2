import pytest
from pyspark.sql import functions as F

from sourceloom.operators import quality, traces


def test_context_precision(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("c", 1, None), ("c", 2, True)]
    out = quality.context_precision(spark.createDataFrame(rows, "question_id string, rank int, relevant boolean"))
    assert {r.question_id: r.context_precision for r in out.collect()} == pytest.approx(
        {"a": (1 + 2 / 3) / 2, "b": 0.0, "c": 0.5})


def test_recall_and_faithfulness(spark):
    rows = [("a", True), ("a", False), ("b", True)]
    out = quality.context_recall(spark.createDataFrame(rows, "question_id string, supported boolean"))
    assert {r.question_id: r.context_recall for r in out.collect()} == {"a": 0.5, "b": 1.0}
    answers = spark.createDataFrame([(1, "The cat sat. A dog ran!\n\nOk.", "the CAT sat on a mat")],
                                    "question_id int, answer string, context string")
    claims = quality.claims(answers)
    assert [(r.claim.strip(), r.supported) for r in claims.orderBy("claim_no").collect()] == [
        ("The cat sat", True), ("A dog ran", False), ("Ok", False)]
    assert quality.faithfulness(claims).first().faithfulness == pytest.approx(1 / 3)


def test_answer_relevancy(spark):
    pairs = spark.createDataFrame([(1, "a b", "a b"), (1, "a b", "c"), (2, "", "x")],
                                  "question_id int, question string, probe_question string")
    out = {r.question_id: r.answer_relevancy for r in quality.answer_relevancy(pairs).collect()}
    assert out == pytest.approx({1: 0.5, 2: 0.0})


def test_failed_questions_keep_a_row(spark):
    pairs = spark.createDataFrame([(1, "q1", "g1"), (2, "q2", "g2")],
                                  "question_id int, question string, ground_truth string")
    results = spark.createDataFrame([(1, "a1", ["c"], "alpha/small")],
                                    "question_id int, answer string, contexts array<string>, model string")
    rows = {r.question_id: r for r in quality.eval_join(pairs, results, F.lit("alpha")).collect()}
    assert rows[1].answer == "a1" and rows[1].contexts == ["c"]
    assert (rows[2].answer, rows[2].contexts, rows[2].model) == ("ERROR", [], "alpha/error")


def test_means_skip_nulls_and_comparison_counts_missing_as_zero(spark):
    wide = spark.createDataFrame([("alpha", 1.0, None), ("alpha", 0.0, 4.0), ("beta", 1.0, None)],
                                 "provider string, recall double, length double")
    means = {r.provider: (r.recall, r.length) for r in quality.eval_means(wide, ["recall", "length"], ["provider"]).collect()}
    assert means == {"alpha": (0.5, 4.0), "beta": (1.0, None)}
    rows = quality.long_scores(wide, ["recall", "length"], ["provider"])
    out = [tuple(r) for r in quality.provider_compare(rows, "alpha", "beta").collect()]
    assert out == [("length", 4.0, 0.0, -4.0), ("recall", 0.5, 1.0, 0.5)]


def test_usage_and_scores(spark):
    rows = [("alpha/s", 10, (1, 2, 3)), ("alpha/s", 20, (1, 2, 3)), ("alpha/s", 20, (1, 2, 3)), ("b/x", 5, (0, 0, 0))]
    df = spark.createDataFrame(rows, "model string, latency_ms long, usage struct<input:long,output:long,total:long>")
    out = {r.model: r for r in traces.usage_by_model(df).collect()}
    a = out["alpha/s"]
    assert (a.requests, a.total_tokens, a.median_latency_ms, a.provider) == (3, 9, 20.0, "alpha")
    assert a.avg_latency_ms == pytest.approx(50 / 3)
    scores = spark.createDataFrame([("t", {"recall": 0.5})], "trace_id string, scores map<string,double>")
    assert tuple(traces.score_rows(scores).first()) == ("t", "recall", 0.5, "RAGAS recall")


def test_median_latency_is_exact_in_wide_buckets(spark):
    from statistics import median

    import numpy as np

    rng = np.random.default_rng(3)
    latencies = {"a/odd": rng.integers(0, 6000, 501).tolist(), "a/even": rng.integers(0, 2**40, 500).tolist(),
                 "b/apart": [100, 5003, 9001, 10**12], "b/below": [-900, -899, -300, 7, None], "b/none": [None],
                 None: [1001, 1003]}
    rows = [(m, x, (1, 1, 2)) for m, xs in latencies.items() for x in xs]
    df = spark.createDataFrame(rows, "model string, latency_ms long, usage struct<input:long,output:long,total:long>")
    out = {r.model: r for r in traces.usage_by_model(df, exact=True).collect()}
    assert {m: r.requests for m, r in out.items()} == {m: len(xs) for m, xs in latencies.items()}
    known = {m: [x for x in xs if x is not None] for m, xs in latencies.items()}
    assert {m: r.median_latency_ms for m, r in out.items()} == {m: median(xs) if xs else None for m, xs in known.items()}


def test_registered_usage_takes_the_exact_median(spark, tmp_path):
    from suite.queries import usage_by_model

    rows = [(i, "view", v, '{"k": 1}') for i, v in enumerate([100.1, 500.3, 500.4, 900.0, 901.0])]
    spark.createDataFrame(rows, "event_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    row = usage_by_model(spark, str(tmp_path)).first()
    assert (row.model, row.requests, row.median_latency_ms) == ("alpha/large", 5, 5004.0)
