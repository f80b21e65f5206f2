"""Files to stored chunks, for all repositories of a job table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.chunks import explode_chunks, with_chunks
from sourceloom.operators.files import eligible_files
from sourceloom.operators.vectors import WORD_COUNTS, Encoder, chunk_text, encoded


def chunk_repositories(files: DataFrame, limits: Limits = DEFAULTS, **options) -> DataFrame:
    """Eligible files of all repositories, each with its array of chunks."""
    return with_chunks(eligible_files(files, limits, **options), limits)


def chunk_rows(files: DataFrame, limits: Limits = DEFAULTS, **options) -> DataFrame:
    return explode_chunks(chunk_repositories(files, limits, **options))


def vector_rows(chunks: DataFrame, encoder: Encoder = WORD_COUNTS) -> DataFrame:
    """Chunks with their vector and the name of its encoder, as they are stored."""
    return encoded(chunks, chunk_text(), chunks.columns, encoder)


def job_rows(repos: DataFrame, files: DataFrame, limits: Limits = DEFAULTS, encoder: Encoder = WORD_COUNTS) -> DataFrame:
    """Rows to store for the repositories of ``repos``: chunks with their vectors."""
    wanted = files.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    return vector_rows(chunk_rows(wanted, limits), encoder)
