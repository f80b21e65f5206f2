"""Merkle fixity audit of web-archive records.

Pages become archive records in files. A file is cut into ``SLOTS`` offset ranges: a record lies in the range that the
digest of its id and address names, so a record keeps its range whatever else a replica lost, gained or changed. The
records of a range are hashed in offset order, ``FAN`` at a time, to one node; nodes of neighbouring ranges are hashed,
level by level, up to one root per file. Two replicas are compared root by root; only below a differing node are
children compared, so agreeing files are left after one row. In the ranges that differ, records are matched by content
and then by id, and reported with their place in either replica: ``changed``, ``missing_left`` or ``missing_right``.

A null id, address or body counts as empty. Bodies are hashed whole. Equal records are one leaf with a number of copies;
where only that number differs, the copies one side lacks are reported in one row. Several records of an id that differ
are paired in the order of their hashes. An empty replica gives one row per distinct record of the other. Files grow in
number with the rows (``FILE_RECORDS``), and no array holds more than ``FAN`` hashes, however many records share an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm import shared

FAN = 16
LEVELS = 3                     # above the ranges
SLOTS = FAN ** LEVELS
FILE_RECORDS = 4096


def record(url: Column, body: Column, key: Column) -> Column:
    """One response record of the archive format: header lines, an empty line, the body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key, F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digest_number(key: Column, first: int, digits: int, modulus: int) -> Column:
    """A number below ``modulus`` from hexadecimal digits of the key's md5 (null: as '')."""
    digest = F.md5(F.coalesce(key, F.lit("")))
    return F.pmod(F.conv(F.substring(digest, first, digits), 16, 10).cast("long"), F.lit(modulus))


def leaves(pages: DataFrame, files: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(file, number, place, offset, size, copies, page_id, hash): one row per distinct record; ``number`` is its range in
    the file, ``place`` its place there, ``offset`` that of its first copy.
    """
    page, text = F.col(key), F.col(key).cast("string")
    written = record(F.col(url), F.col(body), text)
    home = F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(F.col(url), F.lit("")))
    rows = pages.select(digest_number(home, 1, 8, files).alias("file"), digest_number(home, 9, 8, SLOTS).alias("number"),
                        page.alias("page_id"), F.sha2(written, 256).alias("hash"),
                        F.octet_length(written).cast("long").alias("size"))
    held = rows.groupBy("file", "number", "page_id", "hash").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("file").orderBy("number", "page_id", "hash")
    inside = Window.partitionBy("file", "number").orderBy("page_id", "hash")
    taken = F.col("size") * F.col("copies")
    return held.select(
        "file", "number", (F.row_number().over(inside) - 1).cast("long").alias("place"),
        (F.sum(taken).over(order.rowsBetween(Window.unboundedPreceding, 0)) - taken).alias("offset"),
        "size", "copies", "page_id", "hash")


def _joined(nodes: DataFrame, *group: Column | str, order: str) -> DataFrame:
    """One node for each group: the hash of its children's hashes in order."""
    children = F.array_sort(F.collect_list(F.struct(order, "hash")))
    return nodes.groupBy(*group).agg(
        F.sha2(F.concat_ws("", F.transform(children, lambda c: c["hash"])), 256).alias("hash"))


def ranges(leaf: DataFrame, last: int) -> DataFrame:
    """(file, number, hash) of every range that holds records, ``FAN`` records or nodes hashed at a time.

    ``last`` is the last place in a range of either replica, so that both hash equally often.
    """
    nodes = leaf.select("file", "number", "place", F.sha2(F.concat_ws(":", "hash", "copies"), 256).alias("hash"))
    while last > 0:
        nodes = _joined(nodes, "file", "number", F.floor(F.col("place") / FAN).alias("up"), order="place") \
            .withColumnRenamed("up", "place")
        last //= FAN
        if last:
            nodes = shared.cut(nodes)
    return nodes.select("file", "number", "hash")


def parents(nodes: DataFrame) -> DataFrame:
    """Nodes of the next level: the hash of up to ``FAN`` child hashes in order."""
    return _joined(nodes, "file", F.floor(F.col("number") / FAN).alias("up"), order="number") \
        .select("file", F.col("up").alias("number"), "hash")


def tree(leaf: DataFrame, last: int) -> list[DataFrame]:
    """Nodes of every level, from the ranges to the roots."""
    levels = [shared.cut(ranges(leaf, last))]
    for _ in range(LEVELS):
        levels.append(shared.cut(parents(levels[-1])))
    return levels


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, number) of nodes that differ or that one side lacks."""
    r = right.select("file", "number", F.col("hash").alias("other"))
    return left.join(r, ["file", "number"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "number")


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(file, number) of the ranges that differ. Every level is written, so the plan of a level reads the one above."""
    open_ = shared.cut(compare(left[-1], right[-1]))
    for a, b in zip(left[-2::-1], right[-2::-1]):
        up = open_.select("file", F.col("number").alias("up"))
        below = [t.withColumn("up", F.floor(F.col("number") / FAN)).join(up, ["file", "up"], "left_semi") for t in (a, b)]
        open_ = shared.cut(compare(*below))
    return open_


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differing records of two leaf tables: (file, number, page_id, status and page_id, offset, size, hash, copies of
    either side)."""
    left, right = shared.cut(left), shared.cut(right)
    last = left.select("place").union(right.select("place")).agg(F.max("place").alias("n")).first()["n"] or 0
    open_ = differing(tree(left, last), tree(right, last))
    key = ["file", "number", "page_id"]
    rows = None
    for on_left, table in ((True, left), (False, right)):
        side = table.join(open_, ["file", "number"], "left_semi").select(
            *key, "hash", "size", *[F.when(F.lit(on_left == mine), F.col(c)).alias(f"{name}_{c}")
                                    for name, mine in (("left", True), ("right", False)) for c in ("offset", "copies")])
        rows = side if rows is None else rows.unionByName(side)
    held = rows.groupBy(*key, "hash", "size").agg(
        *[F.max(f"{s}_offset").alias(f"{s}_offset") for s in ("left", "right")],
        *[F.coalesce(F.max(f"{s}_copies"), F.lit(0)).alias(f"{s}_copies") for s in ("left", "right")])
    both = F.least("left_copies", "right_copies")
    on_left = F.col("left_copies") > F.col("right_copies")
    more = F.when(on_left, F.col("left_offset")).otherwise(F.col("right_offset")) + F.col("size") * both
    spare = held.where("left_copies <> right_copies").select(
        *key, on_left.alias("on_left"), F.struct(
            "hash", "page_id", more.alias("offset"), "size",
            (F.greatest("left_copies", "right_copies") - both).alias("copies")).alias("record"))
    turn = Window.partitionBy(*key, "on_left").orderBy("record.hash")
    met = spare.withColumn("turn", F.row_number().over(turn)).groupBy(*key, "turn").agg(
        F.max(F.when(F.col("on_left"), F.col("record"))).alias("left"),
        F.max(F.when(~F.col("on_left"), F.col("record"))).alias("right"))
    status = F.when(F.col("left").isNull(), "missing_left").when(F.col("right").isNull(), "missing_right").otherwise("changed")
    return met.select(*key, status.alias("status"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right")
                                                     for c in ("page_id", "offset", "size", "hash", "copies")])


def file_count(pages: DataFrame) -> int:
    return pages.count() // FILE_RECORDS + 1
