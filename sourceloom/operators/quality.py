"""Retrieval-quality metrics over verdict tables, and their comparison between providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions.text import words
from sourceloom.functions.vector import features, sparse_cosine

FAILED_ANSWER = "ERROR"  # fixed value


def context_precision(hits: DataFrame, verdict: str = "relevant") -> DataFrame:
    """Mean of precision@rank over the relevant ranks of a question; 0 where none is relevant.

    ``hits``: question_id, rank and a boolean verdict; at most ``max_top_k`` rows per question.
    """
    v = F.coalesce(F.col(verdict).cast("int"), F.lit(0))
    so_far = F.sum(v).over(W.partitionBy("question_id").orderBy("rank"))
    gained = hits.select("question_id", v.alias("v"), (v * so_far / F.col("rank")).alias("p"))
    return gained.groupBy("question_id").agg(
        F.when(F.sum("v") > 0, F.sum("p") / F.sum("v")).otherwise(0.0).alias("context_precision"))


def supported_share(statements: DataFrame, key: str, name: str,
                    verdict: str = "supported") -> DataFrame:
    """Share of supported statements per ``key``: context recall, and faithfulness."""
    return statements.groupBy(key).agg(F.avg(F.col(verdict).cast("int")).alias(name))


def context_recall(statements: DataFrame, verdict: str = "supported") -> DataFrame:
    return supported_share(statements, "question_id", "context_recall", verdict)


def claims(answers: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """Split answers into sentences. The default verdict: all words of the claim are in the context."""
    parts = F.filter(F.split(F.col(answer), r"[.!?\n]+"), lambda c: F.size(words(c)) > 0)
    one = answers.select(
        "question_id", F.array_distinct(words(F.coalesce(F.col(context), F.lit("")))).alias("_known"),
        F.posexplode(parts).alias("claim_no", "claim"))
    return one.select("question_id", "claim_no", "claim", (
        F.size(F.array_except(words("claim"), F.col("_known"))) == 0).alias("supported"))


def faithfulness(claim_rows: DataFrame, verdict: str = "supported") -> DataFrame:
    return supported_share(claim_rows, "question_id", "faithfulness", verdict)


def answer_relevancy(pairs: DataFrame) -> DataFrame:
    """Mean similarity of a question and the questions that its answer would answer.

    ``pairs``: question_id, question, probe_question.
    """
    one = pairs.select("question_id", F.explode_outer(F.array(F.struct(
        features("question").alias("q"), features("probe_question").alias("p")))).alias("f"))
    return one.groupBy("question_id").agg(
        F.avg(sparse_cosine("f.q", "f.p")).alias("answer_relevancy"))


def eval_join(pairs: DataFrame, results: DataFrame, provider: Column | None = None) -> DataFrame:
    """Evaluation rows: every pair keeps a row; a question without a result gets the error answer."""
    joined = pairs.join(results, "question_id", "left")
    model = F.coalesce(F.col("model"), F.concat(F.lit("unknown") if provider is None else provider,
                                             F.lit("/error")))
    return joined.select(
        "question_id", "question", F.coalesce("answer", F.lit(FAILED_ANSWER)).alias("answer"),
        F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"),
        model.alias("model"), "ground_truth")


def eval_means(scores: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """Mean of every metric column; nulls are skipped."""
    return scores.groupBy(*keys).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])


def long_scores(scores: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Wide metric columns to rows (``metric``, ``value``); nulls are left out."""
    values = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])
    rows = scores.select(*keys, F.explode(values).alias("metric", "value"))
    return rows.where(F.col("value").isNotNull())


def provider_compare(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Mean of every metric for two providers, and second minus first, in metric order.

    ``scores``: provider, metric, value. A metric that one provider lacks counts as 0.
    """
    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("provider") == name, F.col("value"))), F.lit(0.0))

    means = scores.where(F.col("provider").isin(first, second)).groupBy("metric").agg(
        mean(first).alias("first_mean"), mean(second).alias("second_mean"))
    return means.withColumn("difference", F.col("second_mean") - F.col("first_mean")).orderBy("metric")


def recall_at_k(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected (question_id, id) pairs that a search found."""
    hit = found.select("question_id", "id").distinct().withColumn("_hit", F.lit(1))
    return expected.join(hit, ["question_id", "id"], "left").agg(
        F.avg(F.coalesce(F.col("_hit"), F.lit(0))).alias("recall"))
