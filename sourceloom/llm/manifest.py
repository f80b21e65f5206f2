"""Merkle manifest of a dataset, with an inclusion proof and a tamper check for every row.

Every row is a leaf. The leaves of a group (a source) stand in key order; every ``FAN`` consecutive nodes become
their hash, level by level, up to the group's root, and the roots of the groups, in group order, form a tree of the
same kind. ``STOREY`` levels are built at a time, from blocks of ``BLOCK`` consecutive nodes, and stored. From them come
node rows, which name their parent by tree, block and storey and hold the siblings of the levels of a storey. A
recursive query climbs from every leaf: each step joins the row of the node it stands on, emits its siblings and folds
the digest it carries with them, so a leaf that was tampered with arrives at another root.

Hot groups: places come from ranges (``shared.numbered``), a block has at most ``BLOCK`` rows, and the climb meets a node
high above by way of a copy for each lowest block below it. The copies are made downwards, each from its parent's, so
no key of any join has more than ``BLOCK`` rows however large a group is.

A null value of a field enters its leaf as ``-``, a value as byte count, colon and value, so null and empty text
differ. Rows without a group form the first group; an empty group name is a group of its own. Rows with equal (also
null) keys are ordered by leaf hash; wholly equal rows are equal leaves and appear once each. Only the named fields
are read, so other columns may have any name. Texts of any length are hashed whole. An empty table has no root and
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm import shared

FAN = 3
STOREY = 4                      # levels that are built, stored and climbed at a time


def block_size() -> int:
    """Consecutive nodes that share an ancestor one storey above."""
    return FAN ** STOREY


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` or byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def number_leaves(rows: DataFrame) -> DataFrame:
    """Adds tree (place of the group from 1), number (place in the group) and m (rows of the group).

    ``rows``: named (has a group), name (its group or ''), key, hash, rid and others.
    """
    group, order = ["named", "name"], ["key", "hash", "rid"]
    ranged, spans = shared.numbered(rows, group, order)
    groups, group_spans = shared.numbered(spans.select(*group).distinct().withColumn("all", F.lit(0)), ["all"], group)
    groups = groups.join(group_spans, ["all", "span"]).select(
        *group, (shared.place(["all"], group) + 1).alias("tree"))
    known = spans.join(groups, group)
    return ranged.join(known, [*group, "span"]).withColumn("number", shared.place(group, order)) \
        .withColumnRenamed("total", "m").drop("span", "before")


def _storey(nodes: DataFrame) -> DataFrame:
    """Blocks of a storey: tree, m, block, its nodes in order, and level_0 (their hashes) to level_``STOREY``.

    ``nodes``: tree, number, m (nodes of the tree on this level), hash and others. A tree is not hashed further once a
    level has a single node, so its levels repeat from there.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "m", "number")]
    blocks = nodes.groupBy("tree", "m", F.floor(F.col("number") / block_size()).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("number", *rest))).alias("nodes"))
    blocks = blocks.withColumn("level_0", F.transform("nodes", lambda n: n["hash"]))
    for level in range(STOREY):
        below = F.col(f"level_{level}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        lifted = F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(below, r * FAN + 1, F.lit(FAN)), ""), 256))  # noqa: B023
        blocks = blocks.withColumn(f"level_{level + 1}", F.when(F.col("m") > FAN ** level, lifted).otherwise(below))
    return shared.written(blocks)


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(storeys, roots) of the trees whose leaves (tree, number, hash, m, ...) are given; m is the number of leaves.

    Roots: tree, height (storeys), hash.
    """
    most = leaves.agg(F.max("m").alias("m")).first()["m"] or 0
    storeys, roots, current = [], None, leaves
    while most > 0:
        storeys.append(_storey(current))
        top = storeys[-1].select("tree", F.col("block").alias("number"), F.get(f"level_{STOREY}", F.lit(0)).alias("hash"), "m")
        ended = top.where(F.col("m") <= block_size()).select("tree", F.lit(len(storeys)).alias("height"), "hash")
        roots = ended if roots is None else roots.union(ended)
        current = top.where(F.col("m") > block_size()).withColumn("m", F.ceil(F.col("m") / block_size()))
        most = 0 if most <= block_size() else -(-most // block_size())
    if roots is None:
        roots = leaves.select("tree", F.lit(0).alias("height"), "hash")
    return storeys, shared.cut(roots)


def _steps(place: Column) -> Column:
    """Siblings before and after the node at ``place`` of a block, and of its ancestors in the storey, level by level."""
    def step(level: int) -> Column:
        nodes, at = F.col(f"level_{level}"), F.floor(place / FAN ** level).cast("int")
        inside = at % FAN
        return F.when(F.col("m") > FAN ** level, F.struct(
            F.array_join(F.slice(nodes, at - inside + 1, inside), "").alias("before"),
            F.array_join(F.slice(nodes, at + 2, F.lit(FAN - 1) - inside), "").alias("after")))

    return F.filter(F.array(*[step(level) for level in range(STOREY)]), lambda s: s.isNotNull())


def _children(storey: DataFrame) -> DataFrame:
    return storey.select("tree", "m", "block", *[f"level_{i}" for i in range(STOREY)], F.posexplode("nodes").alias("place", "node"))


def _paths(storeys: list[DataFrame], ends: DataFrame, lowest: int) -> DataFrame:
    """(tree, number, path) of the nodes that storey ``lowest`` starts from: (storey, steps) for each storey on the way up.

    ``ends``: tree, height, path (the way above the root of a tree). Every parent hands its path to its children.
    """
    def roots(height: int) -> DataFrame:
        return ends.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("block"), "path")

    above = roots(len(storeys))
    for number in range(len(storeys) - 1, lowest - 1, -1):
        own = F.array(F.struct(F.lit(number).alias("storey"), _steps(F.col("place")).alias("steps")))
        nodes = _children(storeys[number]).join(above, ["tree", "block"]).select(
            "tree", F.col("node.number").alias("block"), F.concat(own, "path").alias("path"))
        above = nodes.union(roots(number)) if number else nodes
    return above


def node_rows(storeys: list[DataFrame], roots: DataFrame, top_storeys: list[DataFrame], top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, blocks). Nodes, the rows that the climb joins: tree, block, storey, steps. Blocks: tree, block, subroot."""
    none = F.array().cast("array<struct<storey:int,steps:array<struct<before:string,after:string>>>>")
    ends = _paths(top_storeys, top.select("tree", "height", none.alias("path")), 0)
    # Group t (from 1) is leaf t - 1 of the top tree, whose storeys follow those of the group's own tree.
    ends = roots.join(ends.select((F.col("block") + 1).alias("tree"), "path"), "tree").select(
        "tree", "height", "hash", F.transform("path", lambda s: F.struct(
            (s["storey"] + F.col("height")).alias("storey"), s["steps"].alias("steps"))).alias("path"))
    blocks = shared.cut(_paths(storeys, ends, 1).join(ends.select("tree", F.col("hash").alias("subroot")), "tree"))
    nodes = blocks.select("tree", "block", F.explode("path").alias("s")).select("tree", "block", "s.*")
    return nodes, blocks.select("tree", "block", "subroot")


FOLD = "unhex(aggregate({steps}, lower(hex({digest})), (d, s) -> sha2(concat(s.before, d, s.after), 256)))"
SIBLINGS = "unhex(array_join(transform({steps}, s -> concat(s.before, s.after)), ''))"
CLIMB = f"""
WITH RECURSIVE climb (rid, tree, block, storey, digest, siblings) AS (
  SELECT rid, tree, block, 1, {FOLD.format(steps="steps", digest="found")}, {SIBLINGS.format(steps="steps")} FROM {{start}}
  UNION ALL
  SELECT c.rid, c.tree, c.block, c.storey + 1, {FOLD.format(steps="n.steps", digest="c.digest")}, {SIBLINGS.format(steps="n.steps")}
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.block = n.block AND c.storey = n.storey)
SELECT rid, storey, digest, siblings FROM climb"""


def climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rid, folded, proof): the digest that each leaf arrives with, and the hash of all siblings on its way.

    ``start``: rid, tree, block, found (its digest), steps of the lowest storey. Spark's bound on the rows of a recursion
    is lifted while it runs: there is one row per leaf and storey.
    """
    spark = start.sparkSession
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        passed = spark.sql(CLIMB, start=start, nodes=nodes)
        siblings = F.array_sort(F.collect_list(F.struct("storey", "siblings")))
        return shared.cut(passed.groupBy("rid").agg(
            F.lower(F.hex(F.max_by("digest", "storey"))).alias("folded_root"),
            F.sha2(F.array_join(F.transform(siblings, lambda s: F.lower(F.hex(s["siblings"]))), ""), 256).alias("proof_sha256")))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def audit(rows: DataFrame, fields: dict[str, Column], tampered: dict[str, Column], key: str = "doc_id",
          group: str = "source") -> DataFrame:
    """One row per input row: the key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields``: the values of a leaf in order; ``tampered``: the same with some replaced, as found later. The proof is
    the hash of all siblings on the way up; the folded root comes from the tampered leaf and the original siblings.
    """
    name = F.col(group)
    leaves = shared.cut(rows.select(
        F.monotonically_increasing_id().alias("rid"), name.isNotNull().alias("named"), F.coalesce(name, F.lit("")).alias("name"),
        F.col(key).alias("key"), leaf_hash(list(fields.values())).alias("hash"),
        F.unhex(leaf_hash(list({**fields, **tampered}.values()))).alias("found")))
    leaves = shared.cut(number_leaves(leaves).select("rid", "key", "hash", "found", "tree", "number", "m"))
    storeys, roots = build(leaves)
    top_storeys, top = build(roots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("number"), "hash",
                                          F.lit(roots.count()).cast("long").alias("m")))
    root = top.first()
    root = F.lit(root["hash"] if root else None).cast("string")
    block = F.floor(F.col("number") / block_size()).alias("block")
    if not storeys:
        return leaves.select(F.col("key").alias(key), F.col("hash").alias("leaf"), root.alias("subroot"), root.alias("root"),
                             root.alias("proof_sha256"), root.alias("folded_root"), root.isNotNull().alias("verified"))
    nodes, blocks = node_rows(storeys, roots, top_storeys, top)
    start = _children(storeys[0]).select("node.rid", "tree", "block", "node.found", _steps(F.col("place")).alias("steps"))
    ways = climb(start, nodes)
    found = leaves.select("rid", "key", "hash", "tree", block).join(ways, "rid").join(blocks, ["tree", "block"])
    return found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", root.alias("root"),
                        "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def audit_documents(docs: DataFrame) -> DataFrame:
    """The audit of ``documents`` against copies whose text lost its line ends wherever the id's checksum is even."""
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    lost = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return audit(docs, fields, {"text": lost})
