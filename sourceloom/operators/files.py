"""Which files of a repository are chunked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.text import as_column, basename, is_blank, suffix
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.ranking import top_per_key
from sourceloom.sources.staging import staged

CUTOFFS_SENT = 200_000     # rows of (repository, path) sent to the tasks at once: some tens of megabytes


def path_parts(path: Column | str) -> Column:
    """Path order is the order of the parts, not of the string (``a/b`` sorts before ``a-c/b``)."""
    return F.split(as_column(path), "/", -1)


def in_skipped_dir(path: Column | str) -> Column:
    """True if a parent directory is in the skip list or starts with a dot."""
    parts = path_parts(path)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(parents, lambda p: p.isin(rules.SKIP_DIRS) | p.startswith("."))


def is_skipped_name(path: Column | str, glob_skip: bool = True) -> Column:
    """True for lock files and, with ``glob_skip``, for generated files such as ``a.min.js``."""
    name = basename(path)
    skipped = name.isin(rules.SKIP_NAMES + rules.SKIP_GLOBS)
    if glob_skip:
        for glob in rules.SKIP_GLOBS:
            skipped = skipped | name.endswith(glob.removeprefix("*"))
    return skipped


def has_size(size: Column | str, max_bytes: int | None) -> Column:
    """Not empty, and not above ``max_bytes`` where that is given."""
    return as_column(size) >= 1 if max_bytes is None else as_column(size).between(1, max_bytes)


def rejections(max_bytes: int | None, glob_skip: bool = True, size: Column | str = "size",
               path: Column | str = "path") -> dict[str, Column]:
    """Every per-file test except those of the content, cheapest first: reason -> whether it rejects the file."""
    size = as_column(size)
    tests = {"empty": size.isNull() | (size < 1)}
    if max_bytes is not None:
        tests["too_large"] = size > max_bytes
    return {**tests, "no_language": ~suffix(path).isin(list(rules.LANGUAGES)),
            "skipped_name": is_skipped_name(path, glob_skip), "skipped_dir": in_skipped_dir(path)}


def is_eligible(max_bytes: int | None, glob_skip: bool = True, size: Column | str = "size",
                path: Column | str = "path") -> Column:
    """No test of ``rejections`` holds. Null paths are not eligible."""
    kept = F.lit(True)
    for rejected in rejections(max_bytes, glob_skip, size, path).values():
        kept = kept & ~rejected
    return F.coalesce(kept, F.lit(False))


def eligible_files(files: DataFrame, limits: Limits = DEFAULTS, max_files: int | None = None,
                   max_bytes: int | None = None, glob_skip: bool = True) -> DataFrame:
    """Eligible files with their language; with ``max_files``, the first of every repository in path order.

    ``files``: repo_id, path, size, content. Without a cap every file is judged alone. Contents are never shuffled for
    the cap: see ``within_cap``.
    """
    kept = files.where(is_eligible(limits.bytes_cap(max_bytes), glob_skip)).where(~is_blank("content"))
    kept = kept.withColumn("language", rules.detect_language("path"))
    cap = limits.files_cap(max_files)
    return kept if cap is None else within_cap(kept, cap)


def within_cap(files: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` files of every repository in path order.

    The decision is made on keys: the ranking sees (repo_id, path) and yields one cut-off path for each repository above
    the cap, written once. Cut-offs are sent to the tasks in blocks of a checked number of rows, one join after the other
    in the same stage, so contents stay where they are however many repositories are above the cap.
    """
    keys = files.select("repo_id", path_parts("path").alias("_parts"))
    ranked = top_per_key(keys, ["repo_id"], [F.col("_parts")], cap + 1, rank="_rank", salt_by=["_parts"])
    # The first row beyond the cap marks the end, so repositories within the cap give no row here.
    cutoffs = staged(ranked.where(F.col("_rank") == cap + 1).select("repo_id", F.col("_parts").alias("_end")))
    blocks = -(-cutoffs.count() // CUTOFFS_SENT)
    kept = files.withColumn("_parts", path_parts("path"))
    for block in range(blocks):
        part = cutoffs.where(F.pmod(F.xxhash64("repo_id"), F.lit(blocks)) == block)
        kept = kept.join(F.broadcast(part), "repo_id", "left").where(
            F.col("_end").isNull() | (F.col("_parts") < F.col("_end"))).drop("_end")
    return kept.select(*files.columns)


def file_outcomes(files: DataFrame, limits: Limits = DEFAULTS, max_files: int | None = None,
                  max_bytes: int | None = None, glob_skip: bool = True) -> DataFrame:
    """(repo_id, path, outcome) of every file: ``eligible``, or the first reason why it is not.

    After the reasons of ``rejections``: ``unreadable`` (no content came with the row), ``blank``, and with a cap
    ``over_cap``. The cap counts eligible files only.
    """
    outcome = F.when(F.col("path").isNull(), "unreadable")
    for reason, rejected in rejections(limits.bytes_cap(max_bytes), glob_skip).items():
        outcome = outcome.when(rejected, reason)
    outcome = outcome.when(F.col("content").isNull(), "unreadable").when(is_blank("content"), "blank").otherwise("eligible")
    judged = files.select("repo_id", "path", outcome.alias("outcome"))
    cap = limits.files_cap(max_files)
    if cap is None:
        return judged
    # Places of equal paths are taken in turn, as by the cap itself; only keys take part.
    eligible = judged.where(F.col("outcome") == "eligible")
    kept = within_cap(eligible, cap)
    over = eligible.select("repo_id", "path").exceptAll(kept.select("repo_id", "path")).withColumn("outcome", F.lit("over_cap"))
    return judged.where(F.col("outcome") != "eligible").unionByName(kept).unionByName(over)


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language, most frequent first; ties by the first path seen."""
    first_seen = F.min(F.struct("repo_id", path_parts("path").alias("parts")))
    return (
        files.groupBy("language")
        .agg(F.count(F.lit(1)).alias("file_count"), first_seen.alias("_first"))
        .orderBy(F.desc("file_count"), F.asc("_first"))
        .drop("_first")
    )
