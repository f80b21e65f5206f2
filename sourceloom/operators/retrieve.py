"""Hits to sources, prompts and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import as_column, location
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.search import fetch_k
from sourceloom.operators.vectors import WORD_COUNTS, Encoder, encoded

# Texts of the prompt.
SYSTEM_PROMPT = """You are an expert code analyst. You are given relevant source code excerpts from a repository and must answer questions about the codebase accurately.

Rules:
1. Answer ONLY based on the code context provided — do not invent or assume implementations not shown.
2. For every specific claim, cite the source using the format: [path/to/file.py:L{start}-L{end}]
3. If the provided context is insufficient to answer confidently, say explicitly: "The provided context doesn't contain enough information to answer this question. You may need to look at [specific area]."
4. Be precise and technical. Use correct terminology for the detected programming language.
5. When referencing function names, class names, or variables, use backticks (e.g., `process_payment`).
"""
NO_CONTEXT = "(No relevant code context found)"
CONTEXT_HEADING, QUESTION_HEADING = "## Retrieved Code Context", "## Question"
CLOSING = "Please answer the question using the code context above. Cite sources for all specific claims."

MAX_BROADCAST_HITS = 500_000    # rows of ids and numbers, some tens of megabytes

SOURCE_FIELDS = ["file_path", "node_type", "node_name", "start_line", "end_line", "language",
                 "content", "score"]


def with_bounds(questions: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Questions that are searched: a null ``top_k`` is the default, one out of bounds is refused (see ``query_gate``)."""
    filled = questions.withColumn("top_k", F.coalesce(F.col("top_k"), F.lit(limits.default_top_k)))
    return filled.where(F.col("top_k").between(1, limits.max_top_k))


def answerable(questions: DataFrame, repos: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """The gate: questions with a valid ``top_k`` whose repository is ready. Everything after it sees only these."""
    ready = repos.where(F.col("status") == "ready").select("repo_id")
    return with_bounds(questions, limits).join(ready, "repo_id", "left_semi")


def with_question_vectors(questions: DataFrame, limits: Limits = DEFAULTS, encoder: Encoder = WORD_COUNTS) -> DataFrame:
    """Vectorize questions in the space of the chunks and add ``fetch_k``."""
    rows = questions.select("question_id", "repo_id", fetch_k("top_k", limits).alias("fetch_k"), "question")
    return encoded(rows, F.col("question"), ["question_id", "repo_id", "fetch_k"], encoder).drop("encoder")


def _keep_disjoint(hits: Column) -> Column:
    """Keep a hit unless its lines overlap those of a hit of the same file that was kept before."""

    def overlaps(a: Column, b: Column) -> Column:
        return ((a["file_path"] == b["file_path"])
                & (a["end_line"] >= b["start_line"]) & (a["start_line"] <= b["end_line"]))

    none = F.filter(hits, lambda h: F.lit(False))
    return F.aggregate(hits, none, lambda kept, h: F.when(
        F.exists(kept, lambda k: overlaps(k, h)), kept).otherwise(F.concat(kept, F.array(h))))


def overlap_dedup(hits: DataFrame) -> DataFrame:
    """Greedy removal of overlapping hits, best first, per question.

    ``hits`` has at most ``max_top_k`` rows per question, so the array of a question is bounded.
    """
    carried = [c for c in hits.columns if c not in ("question_id", "rank")]
    ordered = F.sort_array(F.collect_list(F.struct("rank", *carried)))
    kept = hits.groupBy("question_id").agg(_keep_disjoint(ordered).alias("_kept"))
    return kept.select("question_id", F.posexplode("_kept").alias("_pos", "_h")).select(
        "question_id", (F.col("_pos") + 1).alias("rank"), *[f"_h.{c}" for c in carried])


def hits_with_metadata(hits: DataFrame, metadata: DataFrame, questions: DataFrame,
                       limits: Limits = DEFAULTS) -> DataFrame:
    """Attach stored metadata by chunk id.

    A question has at most ``max_top_k`` hits. While the questions are few enough for that bound to
    fit in memory, the hits are broadcast, so stored contents are filtered where they are read;
    beyond it both sides shuffle by chunk id.
    """
    most = MAX_BROADCAST_HITS // limits.max_top_k
    if questions.select("question_id").limit(most + 1).count() <= most:
        hits = F.broadcast(hits)
    return hits.join(metadata, ["repo_id", "id"])


def to_sources(hits: DataFrame) -> DataFrame:
    """Typed source columns with defaults; rows whose numbers cannot be read are dropped."""
    text = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in
            ("file_path", "node_type", "node_name", "language")}
    number = {c: F.coalesce(F.col(c).cast("string"), F.lit("0")).try_cast("int")
              for c in ("start_line", "end_line")}
    score = F.coalesce(F.col("score").cast("string"), F.lit("0.0")).try_cast("double")
    typed = hits.withColumns({**text, **number, "score": score,
                              "content": F.coalesce(F.col("content"), F.lit(""))})
    return typed.where(F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
                       & F.col("score").isNotNull())


def rag_sources(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Sources of every question: overlaps removed, then the best ``top_k``."""
    kept = overlap_dedup(hits).join(questions.select("question_id", "top_k"), "question_id")
    return to_sources(kept.where(F.col("rank") <= F.col("top_k"))).select(
        "question_id", "repo_id", "rank", "id", *SOURCE_FIELDS)


def source_arrays(sources: DataFrame) -> DataFrame:
    """One row per question with its sources as an array in rank order (at most ``max_top_k``)."""
    items = F.sort_array(F.collect_list(F.struct("rank", *SOURCE_FIELDS)))
    return sources.groupBy("question_id").agg(items.alias("sources"))


def context_block(sources: Column | str) -> Column:
    """Numbered headers with fenced code; a placeholder where there are no sources."""

    def part(s: Column, i: Column) -> Column:
        return F.concat(
            F.lit("## ["), (i + 1).cast("string"), F.lit("] "),
            location(s["file_path"], s["start_line"], s["end_line"]), F.lit(" ("), s["language"],
            F.lit(" "), s["node_type"], F.lit(": "), s["node_name"], F.lit(")\n```"), s["language"],
            F.lit("\n"), s["content"], F.lit("\n```"))

    block = F.array_join(F.transform(as_column(sources), part), "\n\n")
    return F.coalesce(F.nullif(block, F.lit("")), F.lit(NO_CONTEXT))


def user_message(repo_name: Column | str, question: Column | str, context: Column | str) -> Column:
    return F.concat(
        F.lit("Repository: "), as_column(repo_name), F.lit(f"\n\n{CONTEXT_HEADING}\n\n"),
        as_column(context), F.lit(f"\n\n{QUESTION_HEADING}\n\n"), as_column(question),
        F.lit("\n\n" + CLOSING))


def prompts(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """The message pair of every question, ready for batch inference elsewhere.

    ``questions``: question_id, repo_id, repo_name, question.
    """
    joined = questions.join(source_arrays(sources), "question_id", "left")
    message = user_message("repo_name", "question", context_block("sources"))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), message.alias("content")))
    return joined.select("question_id", "repo_id", messages.alias("messages"),
                         F.coalesce(F.size("sources"), F.lit(0)).alias("source_count"))


def query_gate(questions: DataFrame, repos: DataFrame, hits: DataFrame,
               limits: Limits = DEFAULTS) -> DataFrame:
    """Outcome of every question: invalid, not_found, not_ready, no_results or ok."""
    counts = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("hit_count"))
    top_k = F.coalesce(F.col("top_k"), F.lit(limits.default_top_k))
    status = repos.select("repo_id", "status")
    joined = (questions.withColumn("top_k", top_k).join(status, "repo_id", "left")
              .join(counts, "question_id", "left"))
    outcome = (F.when(~F.col("top_k").between(1, limits.max_top_k), "invalid")
               .when(F.col("status").isNull(), "not_found")
               .when(F.col("status") != "ready", "not_ready")
               .when(F.coalesce(F.col("hit_count"), F.lit(0)) == 0, "no_results")
               .otherwise("ok"))
    return joined.select("question_id", "repo_id", "top_k", "status",
                         F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
                         outcome.alias("outcome"))
