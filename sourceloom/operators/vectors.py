"""Chunks to vectors, and the table of vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import embedding_text
from sourceloom.functions.vector import features, folded, squared_norm
from sourceloom.limits import DEFAULTS, Limits

METADATA = ["repo_id", "file_path", "language", "node_type", "node_name", "start_line", "end_line",
            "token_count"]


@dataclass(frozen=True)
class Encoder:
    """Texts to vectors, for chunks and questions alike.

    ``encode`` maps a text column to a struct (buckets, tfs) for kind ``sparse``, or to an array of floats of one length
    for kind ``dense``; it may be built of column functions or be a ``pandas_udf``. ``name`` is stored beside the vectors,
    and a search sees only vectors of its own encoder, so vectors of two encoders can lie in one store.
    """
    name: str
    kind: str
    encode: Callable[[Column], Column]
    digits: int = 4           # places of a dense score

    def __post_init__(self):
        if self.kind not in ("sparse", "dense"):
            raise ValueError(f"unknown kind of vectors: {self.kind}")

    @property
    def columns(self) -> list[str]:
        return ["buckets", "tfs", "norm2"] if self.kind == "sparse" else ["vector"]


WORD_COUNTS = Encoder("word-counts-1024", "sparse", features)
FOLDED_COUNTS = Encoder("folded-counts-64", "dense", folded)


def encoded(rows: DataFrame, text: Column, keep: list[str], encoder: Encoder = WORD_COUNTS) -> DataFrame:
    """``keep`` with the vector of ``text`` and the name of its encoder. Map-only."""
    if encoder.kind == "sparse":
        vectors = sparse_vectors(rows, text, keep, encoder.encode)
    else:
        vectors = rows.select(*keep, encoder.encode(text).alias("vector"))
    return vectors.withColumn("encoder", F.lit(encoder.name))


def chunk_text() -> Column:
    """The text of a chunk row that is vectorized."""
    return embedding_text("context_header", "node_type", "node_name", "content")


def vector_metadata(chunks: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """What is stored next to a vector; the content is cut only where the limits bound it."""
    content = F.col("content")
    if limits.metadata_chars is not None:
        content = F.substring(content, 1, limits.metadata_chars).alias("content")
    return chunks.select("id", *METADATA, content)


def sparse_vectors(rows: DataFrame, text: Column, keep: list[str],
                   encode: Callable[[Column], Column] = features) -> DataFrame:
    """One sparse vector per row: distinct buckets, their counts, and the squared norm.

    Hashing and counting happen inside the row, so this adds no shuffle.
    """
    vectors = rows.select(*keep, encode(text).alias("_f"))
    # A generator keeps the counts from being computed again by later column references.
    one = vectors.select(*keep, F.explode_outer(F.array("_f")).alias("_v"))
    return one.select(*keep, "_v.buckets", "_v.tfs", squared_norm("_v.tfs").alias("norm2"))


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    return sparse_vectors(chunks, chunk_text(), ["id", "repo_id"])


def sparse_features(vectors: DataFrame) -> DataFrame:
    """Long form: one row per chunk and bucket."""
    pair = F.explode(F.arrays_zip("buckets", "tfs")).alias("p")
    return vectors.select("id", "repo_id", pair).select(
        "id", "repo_id", F.col("p.buckets").alias("bucket"), F.col("p.tfs").cast("bigint").alias("tf"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Vectors and tokens per repository, and the total in a row with a null repository."""
    return chunks.rollup("repo_id").agg(
        F.count(F.lit(1)).alias("vector_count"),
        F.sum(F.col("token_count").cast("bigint")).alias("token_count"),
    )
