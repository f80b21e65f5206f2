"""Trace, usage and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions.text import as_column

# Cuts and names of trace records.
CONTENT_CUT, CONTEXT_CHUNKS, CONTEXT_CUT = 300, 3, 500
SKETCH_BITS = 7
QUERY_TRACE, INGEST_TRACE, SCORE_PREFIX = "codebase-query", "repo-ingestion", "RAGAS "


def provider(model: Column | str) -> Column:
    return F.substring_index(as_column(model), "/", 1)


def generation_input(question: Column | str, contents: Column | str) -> Column:
    """Short form of what was asked: the question and the start of the first contexts."""
    cut = F.transform(F.slice(as_column(contents), 1, CONTEXT_CHUNKS),
                      lambda c: F.substring(c, 1, CONTENT_CUT))
    return F.concat(F.lit("Q: "), as_column(question), F.lit("\nContext: "),
                    F.substring(F.array_join(cut, "\n\n"), 1, CONTEXT_CUT), F.lit("..."))


def query_traces(answers: DataFrame) -> DataFrame:
    """One trace row per answered question.

    ``answers``: trace_id, repo_id, question, contents (array), answer, model, top_k, latency_ms,
    prompt_tokens, completion_tokens, total_tokens (null counts as 0).
    """
    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    usage = F.struct(tokens("prompt_tokens").alias("input"),
                     tokens("completion_tokens").alias("output"),
                     tokens("total_tokens").alias("total"))
    return answers.select(
        "trace_id", F.lit(QUERY_TRACE).alias("name"), "repo_id", "question", "model",
        provider("model").alias("provider"), "top_k", "latency_ms",
        F.size("contents").alias("chunks_retrieved"),
        generation_input("question", "contents").alias("generation_input"), "answer",
        usage.alias("usage"), F.array(F.lit("query"), provider("model")).alias("tags"))


def ingest_traces(summary: DataFrame) -> DataFrame:
    """One trace row per ingestion. ``summary`` has the counters and ``duration_seconds``."""
    return summary.select(
        F.lit(INGEST_TRACE).alias("name"), "repo_id", "github_url", "file_count", "chunk_count",
        "vectors_upserted", F.bround("duration_seconds", 2).alias("duration_seconds"), "status",
        "error", F.array(F.lit("ingestion"), F.col("status")).alias("tags"))


def score_rows(scores: DataFrame, trace_id: str = "trace_id", values: str = "scores") -> DataFrame:
    """One row per trace and metric from a map of metric values."""
    return scores.select(trace_id, F.explode(values).alias("name", "value")).select(
        trace_id, "name", "value", F.concat(F.lit(SCORE_PREFIX), F.col("name")).alias("comment"))


def scored_traces(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """Traces with their score rows; a trace without scores gives no row."""
    return traces.join(scores, "trace_id")


def latency_bucket(latency: Column | str) -> Column:
    """The middle of the bucket of a latency: numbers below 2**``SKETCH_BITS`` are their own, above that buckets hold the
    numbers with equal leading ``SKETCH_BITS`` bits. The middle is off by at most 1 / 2**``SKETCH_BITS`` of the value.
    """
    value = F.greatest(as_column(latency).cast("bigint"), F.lit(0).cast("bigint"))
    low_bits = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), low_bits)
    return (F.call_function("shiftright", value, low_bits) * width + F.floor(width / 2)).cast("bigint")


def usage_sketches(traces: DataFrame, *keys: str) -> DataFrame:
    """Mergeable usage per ``keys`` (``model`` among them, others a day, say) and latency bucket.

    A model has at most ``SKETCH_BITS`` - 1 bits' worth of buckets for each of 63 bit lengths, whatever its number of
    requests or of distinct latencies.
    """
    return traces.groupBy(*keys, latency_bucket("latency_ms").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("usage.input").alias("input"), F.sum("usage.output").alias("output"),
        F.sum("usage.total").alias("total"), F.sum(F.col("latency_ms").cast("bigint")).alias("latency"))


def merge_usage(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of several days, or parts of a day, added up over ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(
        *[F.sum(c).alias(c) for c in ("n", "input", "output", "total", "latency")])


def sketch_usage(sketches: DataFrame, share: float = 0.5) -> DataFrame:
    """Requests, tokens and latency per model from its sketch. Counts, sums and the mean are exact; the median (or another
    ``share``) is that of the buckets.
    """
    return sketches.groupBy("model").agg(
        F.sum("n").alias("requests"), F.sum("input").alias("prompt_tokens"),
        F.sum("output").alias("completion_tokens"), F.sum("total").alias("total_tokens"),
        (F.sum("latency") / F.sum("n")).alias("avg_latency_ms"),
        F.percentile("bucket", F.lit(share), F.col("n")).alias("median_latency_ms"),
    ).withColumn("provider", provider("model"))


def _ordered_bucket(latency: str) -> Column:
    """``latency_bucket`` in the order of all numbers, negative ones included."""
    value = F.col(latency).cast("bigint")
    return F.when(value < 0, F.bitwise_not(latency_bucket(F.bitwise_not(value)))).otherwise(latency_bucket(value))


def median_latency(traces: DataFrame) -> DataFrame:
    """(model, median_latency_ms): the exact median of the known latencies of every model.

    Counts per bucket tell in which one or two buckets the middle lies; only the latencies in these are put in order.
    """
    counted = traces.where(F.col("latency_ms").isNotNull()).groupBy("model", "latency_ms").agg(
        F.count(F.lit(1)).alias("n")).withColumn("bucket", _ordered_bucket("latency_ms"))
    model = Window.partitionBy("model")
    placed = counted.groupBy("model", "bucket").agg(F.sum("n").alias("size")).select(
        F.col("model").alias("of"), F.col("bucket").alias("within"), "size",
        (F.sum("size").over(model.orderBy("bucket")) - F.col("size")).alias("before"),
        F.sum("size").over(model).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.where((F.col("before") <= high) & (F.col("before") + F.col("size") > low))
    rows = counted.join(F.broadcast(middle), F.col("model").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("within")))
    end = F.col("before") + F.sum("n").over(Window.partitionBy("model", "bucket").orderBy("latency_ms"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("end") - F.col("n") <= place) & (place < F.col("end")), F.col("latency_ms").cast("double")))

    return rows.withColumn("end", end).groupBy("model").agg((at(low) * 0.5 + at(high) * 0.5).alias("median_latency_ms"))


def usage_by_model(traces: DataFrame, exact: bool = False) -> DataFrame:
    """Requests, tokens and latency per model; the median is exact, or within 1 / 2**``SKETCH_BITS`` of the value."""
    usage = sketch_usage(merge_usage(usage_sketches(traces, "model"), "model"))
    if not exact:
        return usage
    median = median_latency(traces).withColumnRenamed("model", "of")
    return usage.drop("median_latency_ms").join(median, F.col("model").eqNullSafe(F.col("of")), "left").select(*usage.columns)
