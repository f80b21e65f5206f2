"""Source trees by a walk of their folders: every name and empty files, and no look into skipped folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions import rules
from sourceloom.functions.text import decode_utf8
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.files import is_eligible

ENTRIES = "repo_id string, path string, size long, folder boolean"
LISTED = 10_000            # entries in a batch
READ_BYTES = 16 << 20      # contents in a batch, beyond the first file


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of ``root``, a local path or an address that Arrow knows, and the path there."""
    if "://" not in root:
        return arrow_fs.LocalFileSystem(), os.path.abspath(root)
    return arrow_fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1).rstrip("/"))


def skipped_folder(name: str) -> bool:
    return name.startswith(".") or name in rules.SKIP_DIRS


def _entries(files: arrow_fs.FileSystem, base: str, path: str, every_file: bool) -> Iterator[tuple[str, int | None, bool]]:
    """(path, size, whether it is a folder) of what lies in the folder ``path``; linked folders are left out."""
    local = isinstance(files, arrow_fs.LocalFileSystem)
    for info in files.get_file_info(arrow_fs.FileSelector(f"{base}/{path}" if path else base)):
        folder = info.type == arrow_fs.FileType.Directory
        if folder and ((local and os.path.islink(info.path)) or (not every_file and skipped_folder(info.base_name))):
            continue
        yield f"{path}/{info.base_name}" if path else info.base_name, None if folder else info.size, folder


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], full) -> Iterator[pa.RecordBatch]:
    """Rows in batches; ``full`` tells from the rows of a batch whether it ends there."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if full(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


_ENTRY = (["repo_id", "path", "size", "folder"], [pa.string(), pa.string(), pa.int64(), pa.bool_()])


def _list(root: str, every_file: bool, deep: bool):
    """Folders become what lies in them, with ``deep`` at any depth; files pass."""
    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        files, base = opened(root)
        for repo, path, size, folder in rows:
            if not folder:
                yield repo, path, size, folder
                continue
            todo = [path]
            while todo:
                for found, size, inner in _entries(files, f"{base}/{repo}" if repo else base, todo.pop(), every_file):
                    if inner and deep:
                        todo.append(found)
                    else:
                        yield repo, found, size, inner

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(walk(rows), *_ENTRY, lambda held: len(held) >= LISTED)

    return scan


def _read(root: str):
    def content(files: arrow_fs.FileSystem, path: str) -> bytes | None:
        try:
            with files.open_input_stream(path, compression=None) as stream:
                return stream.read()
        except (OSError, pa.ArrowException):
            return None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        rows = ((repo, path, size, content(files, "/".join(p for p in (base, repo, path) if p)))
                for b in batches for repo, path, size in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(rows, ["repo_id", "path", "size", "content"],
                            [pa.string(), pa.string(), pa.int64(), pa.binary()],
                            lambda held: sum(len(r[3] or b"") for r in held) >= READ_BYTES or len(held) >= 500)

    return scan


def _listed(spark: SparkSession, root: str, single: bool, every_file: bool) -> DataFrame:
    """(repo_id, path, size) of files; the repository of a ``single`` one is ''."""
    tasks = 4 * spark.sparkContext.defaultParallelism

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "repo_id", "path")

    first = spark.createDataFrame([("", "", None, True)], ENTRIES)
    if not single:
        # Names of repositories are not judged.
        first = dealt(first.mapInArrow(_list(root, True, False), ENTRIES).where("folder").select(
            F.col("path").alias("repo_id"), F.lit("").alias("path"), "size", "folder"))
    inside = dealt(first.mapInArrow(_list(root, every_file, False), ENTRIES))
    return inside.mapInArrow(_list(root, every_file, True), ENTRIES).drop("folder")


def _named(files: DataFrame, repo_id: str | None) -> DataFrame:
    return files if repo_id is None else files.withColumn("repo_id", F.lit(repo_id))


def list_tree(spark: SparkSession, root: str, repo_id: str | None = None, every_file: bool = False) -> DataFrame:
    """(repo_id, path, size) of the files below ``root``; skipped folders are listed with ``every_file`` only.

    Without ``repo_id`` each folder directly below ``root`` is a repository, and files beside them are left out. The
    folders of ``root``, then those of the repositories, are dealt to tasks, so a large repository is walked by several.
    A task keeps the folders it has still to visit, no files.
    """
    return _named(_listed(spark, root, repo_id is not None, every_file), repo_id)


def walk_tree(spark: SparkSession, root: str, repo_id: str | None = None, limits: Limits = DEFAULTS,
              max_bytes: int | None = None, glob_skip: bool = True, every_file: bool = False) -> DataFrame:
    """Files below ``root`` as repo_id, path, size, content, as ``tree.scan_tree`` gives them.

    Spark's listing, which ``scan_tree`` uses, has no names that begin with ``_`` or ``.`` (``__init__.py``) and no empty
    files; the walk finds them. Skipped folders are not entered, and rejected files are not opened. A file that cannot be
    read has null content, which ``file_outcomes`` reports. Files are dealt to the reading tasks by name.
    """
    files = _listed(spark, root, repo_id is not None, every_file)
    if not every_file:
        files = files.where(is_eligible(limits.bytes_cap(max_bytes), glob_skip))
    dealt = files.repartition(4 * spark.sparkContext.defaultParallelism, "repo_id", "path")
    read = dealt.mapInArrow(_read(root), "repo_id string, path string, size long, content binary")
    return _named(read.withColumn("content", decode_utf8("content")), repo_id)
