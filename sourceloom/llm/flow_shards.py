"""Resharding by minimum-cost flow.

Rows lie in old shards; new shards have capacities. Sizes are added up per (old shard, block), where a block is
a hash range of rows. A flow from old shards to new ones, at no cost where a shard keeps its number and one
per byte elsewhere, gives the transfers that move the fewest bytes; it is solved on shard totals, so the
driver sees a few numbers per shard. Blocks of a shard lie end to end in block order, the flow cuts that
line into stretches, and a row goes where its middle byte lies. So new shards meet their share of bytes up
to the size of one row per stretch. The law is by bytes; equal texts are not kept together, because a group
of copies may be larger than a shard.

A null text has no bytes. Texts are measured whole. Rows of one block are ordered by id, checksum and size, so
equal rows are interchangeable. An empty table gives no rows. Capacities are relative; 0 empties a shard.
Input columns are kept out of the result but for the id, so clashing names do not matter. Only ids, sizes and
checksums are shuffled, never texts; hot shards are many blocks (``BLOCK_ROWS`` rows each, counted first).
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourceloom.llm import shared

BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest flow that ships every supply within the demands; successive shortest paths with potentials.

    ``sum(demand)`` must be at least ``sum(supply)``. ``cost(i, j)`` >= 0.
    """
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (n + m)
    while any(left):
        # Shortest reduced distances from all supplies with something left; edges i -> j are unbounded,
        # j -> i may take back what flows.
        distance = [0 if i < n and left[i] else None for i in range(n + m)]
        parent: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        done = [False] * (n + m)
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            edges = [(n + j, cost(v, j)) for j in range(m)] if v < n else \
                [(i, -cost(i, v - n)) for i in range(n) if flow.get((i, v - n))]
            for w, c in edges:
                reduced = d + c + potential[v] - potential[w]
                if not done[w] and (distance[w] is None or reduced < distance[w]):
                    distance[w], parent[w] = reduced, v
                    heapq.heappush(heap, (reduced, w))
        open_ = [(distance[n + j] + potential[n + j], j) for j in range(m) if room[j] and distance[n + j] is not None]
        _, target = min(open_)
        far = max(d for d in distance if d is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, distance)]
        path, v = [], n + target
        while parent[v] is not None:
            path.append((parent[v], v))
            v = parent[v]
        amount = min([left[v], room[target]] + [flow[(b, a - n)] for a, b in path if a >= n])
        for a, b in path:
            edge = (a, b - n) if a < n else (b, a - n)
            flow[edge] = flow.get(edge, 0) + (amount if a < n else -amount)
        left[v] -= amount
        room[target] -= amount
    return {e: f for e, f in flow.items() if f}


def shares(total: int, capacities: list[int]) -> list[int]:
    """``total`` split in proportion to ``capacities``, in integers that add up to it."""
    ends = [total * c // sum(capacities) for c in accumulate(capacities)]
    return [b - a for a, b in zip([0, *ends], ends)]


def transfers(old_sizes: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end byte, new shard) stretches that move the fewest bytes.

    A shard's own bytes come first, so the stretch that stays begins at 0.
    """
    old = sorted(old_sizes)
    demand = shares(sum(old_sizes.values()), capacities)
    flow = min_cost_flow([old_sizes[s] for s in old], demand, lambda i, j: int(old[i] != j))
    out = []
    for i, s in enumerate(old):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != s, j)):
            out.append((s, at, at + flow[(i, j)], j))
            at += flow[(i, j)]
    return out


def reshard(docs: DataFrame, old_shard: Column, capacities: list[int], id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for every row of ``docs``."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), old_shard.alias("old_shard"))
    blocks = rows.count() // BLOCK_ROWS + 1
    rows = shared.cut(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks))))
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    totals = sizes.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()
    plan = transfers({r["old_shard"]: r["bytes"] for r in totals}, capacities)

    line = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("old_shard", "block", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("before", before).join(begins, ["old_shard", "block"])
    cuts = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"),
                              F.lit(j).alias("j")) for s, a, b, j in plan]) if plan else None
    if cuts is None:
        return placed.select("doc_id", "size", "text_crc32", "old_shard", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    at = F.col("begin") + F.col("before") + F.floor(F.col("size") / 2)
    shard = F.get(F.filter(cuts, lambda c: (c["s"] == F.col("old_shard")) & (c["a"] <= at) & (at < c["b"])), F.lit(0))["j"]
    placed = shared.cut(placed.select("doc_id", "size", "text_crc32", "old_shard", "block", shard.alias("shard")))

    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("number", F.row_number().over(inside) - 1) \
        .join(firsts, ["shard", "old_shard", "block"]) \
        .select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("number")).alias("slot"))


def rewrite(spark: SparkSession, old_paths: dict[int, str], old_shard_of: str, assignment: DataFrame, out: str,
            key: list[str]) -> dict[int, list[str]]:
    """Write the files of shards that gain or lose rows; return the paths of every new shard.

    ``old_paths`` has the Parquet folder of each old shard. A shard that keeps exactly its rows keeps its folder.
    ``assignment`` has the ``key`` columns, ``old_shard_of`` and shard, one row per row of the shards. Rows of one key
    in one old shard are numbered on both sides, so each goes to one place; they are interchangeable only if the key
    tells different rows apart. Numbers are given inside (key, old shard).
    """
    moved = assignment.where(F.col(old_shard_of) != F.col("shard"))
    touched = {r[0] for c in (old_shard_of, "shard") for r in moved.select(c).distinct().collect()}
    if not touched:
        return {s: [p] for s, p in old_paths.items()}
    parts = [spark.read.parquet(p).withColumn("_old", F.lit(s)) for s, p in old_paths.items() if s in touched]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    copies = Window.partitionBy("_old", *[F.col(f"_{k}") for k in key])
    to = assignment.where(F.col(old_shard_of).isin(sorted(touched))).select(
        *[F.col(k).alias(f"_{k}") for k in key], F.col(old_shard_of).alias("_old"), F.col("shard").alias("_shard")) \
        .withColumn("_copy", F.row_number().over(copies.orderBy("_shard")))
    # Copies come in any order, so their numbers are written down before they are joined.
    rows = shared.cut(rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_old", *key).orderBy(F.lit(0)))))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [rows[c] == to[c] for c in ("_old", "_copy")]
    rows.join(to, on).drop("_old", "_copy", *[f"_{k}" for k in key]).write.partitionBy("_shard").parquet(out)
    kept = {s: [p] for s, p in old_paths.items() if s not in touched}
    return kept | {s: [f"{out}/_shard={s}"] for s in sorted(touched)}
