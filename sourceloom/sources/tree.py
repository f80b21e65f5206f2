"""Readers: source trees, evaluation pairs, job messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.text import decode_utf8
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.files import is_eligible

EVAL_PAIRS = "question string, ground_truth string"


def scan_tree(spark: SparkSession, root: str, repo_id: Column | str | None = None,
              limits: Limits = DEFAULTS, max_bytes: int | None = None, glob_skip: bool = True,
              every_file: bool = False) -> DataFrame:
    """Files below ``root`` as repo_id, path, size, content.

    By default the first directory level names the repository and the rest is the path inside it. Names, directories,
    languages and sizes are judged on the listing, before any file is opened: the conditions are on file metadata, which
    Spark applies to the list of files, so skipped directories and files are not read. With ``every_file`` all are read
    (for ``file_outcomes``). Spark lists no empty files, and no names that begin with
    ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]

    def parts(whole: Column) -> tuple[Column, Column]:
        inside = F.substring(whole, F.locate(base + "/", whole) + len(base) + 1, 1 << 20)
        if repo_id is not None:
            return (F.lit(repo_id) if isinstance(repo_id, str) else repo_id), inside
        name = F.substring_index(inside, "/", 1)
        return name, F.substring(inside, F.length(name) + 2, 1 << 20)

    if not every_file:
        # Listed paths are addresses, in which blanks and some other characters are escaped.
        listed = parts(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))[1]
        files = files.where(is_eligible(limits.bytes_cap(max_bytes), glob_skip, F.col("_metadata.file_size"), listed))
    name, path = parts(F.col("path"))
    return files.select(name.alias("repo_id"), path.alias("path"),
                        F.col("length").alias("size"), decode_utf8("content").alias("content"))


def read_eval_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Question and ground-truth pairs from a JSON array."""
    return spark.read.schema(EVAL_PAIRS).option("multiLine", "true").json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Job messages, one JSON text per line."""
    return spark.read.text(path)
