"""Questions to sources and prompts, for a whole table of questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.repos import repo_name
from sourceloom.operators.retrieve import (
    answerable, hits_with_metadata, prompts, query_gate, rag_sources, with_bounds, with_question_vectors,
)
from sourceloom.operators.search import search_dense, search_sparse
from sourceloom.operators.vectors import WORD_COUNTS, Encoder, chunk_text, encoded, vector_metadata
from sourceloom.sources.staging import staged


def find_hits(chunks: DataFrame, questions: DataFrame, limits: Limits = DEFAULTS,
              encoder: Encoder = WORD_COUNTS) -> DataFrame:
    """Ranked hits of every question in its repository.

    ``chunks`` may be stored rows with vectors, of which those of ``encoder`` are searched; without vectors they are made
    here. Where a shared folder is named, the hits are written there at once, and vectors reach the workers in small batches.
    """
    if "encoder" in chunks.columns:
        if not set(encoder.columns) <= set(chunks.columns):
            raise ValueError(f"chunks hold no vectors of {encoder.name}")
        vectors = chunks.where(F.col("encoder") == encoder.name)
    elif encoder.columns[0] in chunks.columns:
        vectors = chunks
    else:
        vectors = encoded(chunks, chunk_text(), ["id", "repo_id"], encoder)
    vectors = vectors.select("id", "repo_id", *encoder.columns)
    asked = with_question_vectors(questions, limits, encoder)
    hits = search_sparse(vectors, asked) if encoder.kind == "sparse" else search_dense(vectors, asked, encoder.digits)
    return staged(hits, small_batches=True)


def answer_sources(chunks: DataFrame, questions: DataFrame, limits: Limits = DEFAULTS, encoder: Encoder = WORD_COUNTS,
                   repos: DataFrame | None = None) -> DataFrame:
    """Sources of every question with a valid ``top_k``: search, metadata, overlap removal, trim to ``top_k``.

    With ``repos`` (repo_id, status), only questions to ready repositories are searched.
    """
    questions = with_bounds(questions, limits) if repos is None else answerable(questions, repos, limits)
    if "encoder" in chunks.columns:
        chunks = chunks.where(F.col("encoder") == encoder.name)
    hits = hits_with_metadata(find_hits(chunks, questions, limits, encoder), vector_metadata(chunks, limits),
                              questions, limits)
    return rag_sources(hits, questions)


def question_prompts(chunks: DataFrame, questions: DataFrame, repos: DataFrame, limits: Limits = DEFAULTS,
                     encoder: Encoder = WORD_COUNTS, ready_only: bool = True) -> DataFrame:
    """Prompt rows of the questions that pass the gate. ``repos``: repo_id, url, status.

    Without ``ready_only``, of all questions with a valid ``top_k``, whatever is known of their repository.
    """
    asked = answerable(questions, repos, limits) if ready_only else with_bounds(questions, limits)
    named = asked.join(repos.select("repo_id", "url"), "repo_id", "left").withColumn(
        "repo_name", F.coalesce(repo_name("url"), F.col("repo_id")))
    return prompts(named, answer_sources(chunks, asked, limits, encoder))


def question_outcomes(chunks: DataFrame, questions: DataFrame, repos: DataFrame, limits: Limits = DEFAULTS,
                      encoder: Encoder = WORD_COUNTS, ready_only: bool = True) -> DataFrame:
    """Outcome of every question; only those that pass the gate are searched, or all without ``ready_only``."""
    if ready_only:
        asked = answerable(questions, repos, limits)
    else:
        asked = questions.withColumn("top_k", F.coalesce("top_k", F.lit(limits.default_top_k)))
    return query_gate(questions, repos, find_hits(chunks, asked, limits, encoder), limits)
