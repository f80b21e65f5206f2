"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions. For an anchor and a row, the angles to any
reference bound the angle between the two from both sides (triangle inequality on the sphere); the cosines of these
bounds times the norms, rounded outwards, are an interval of the score. Rows stand in order of their nearest
reference and the angle to it, and are taken in strips: only where the interval of a strip reaches an anchor's window
are integer scores computed. The window of a positive search is what is not below the fifth best score so far, that of
a negative search reaches from ``low`` percent of the positive's score to the positive's score.

The anchors are the stated queries. They go to the tasks in blocks of ``ANCHOR_BYTES``, and the rows are scored where
they lie; a task returns the best few of each anchor and window, which Spark merges. References come from a sample of
``SAMPLE`` rows; any directions give the same rows, they only decide how much is skipped. (Vectors without structure
have angles near 90 degrees to everything, so little can be skipped there.)

Rows with a null label, a null vector, a null or non-finite component take no part, and neither do rows whose integer
norm is 2**31 or more, as their scores fit no long. A null id takes part, is never an anchor, and comes last in ties.
Rows are told apart by place, not by id: repeated rows are separate anchors, positives and negatives; ties of equal id
have no defined order among themselves, which only shows if their scores or labels differ. A shorter vector counts as
filled up with zeros. An empty table, or one without anchors, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm import shared

REFERENCES = 16
SAMPLE = 2048
ANCHOR_BYTES = 8 << 20
STRIP = 128                    # rows bounded together
SLACK = 1e-5                   # radians, above the error of an angle stored as a float
SCALE = 256

ROW = "rid long, id long, label int, norm double, angles array<float>, vector array<long>"


def prepare(rows: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rid, id, label, vector) of the rows that take part; vector in whole numbers."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE))
    known = rows.where(F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"),
        label.cast("int").alias("label"), whole.alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return known.where(F.col("label").isNotNull() & (squares < 2.0 ** 62))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros; as floats where every product of two rows is exact in them."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(lengths.max(initial=0), width or 0)), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _angles(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    lists = batch.column("angles")
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy()
    return flat.astype(float).reshape(batch.num_rows, len(flat) // max(batch.num_rows, 1))


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of rows. Floats are exact while no sum of products can pass 2**53."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = width * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if most < 2 ** 53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def references(sample: np.ndarray, count: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Unit directions that stand for the sample: centres of its clusters by angle."""
    norms = np.sqrt((sample.astype(float) ** 2).sum(1))
    units = sample[norms > 0] / norms[norms > 0, None]
    centres = units[:: max(1, -(-len(units) // count))][:count]
    for _ in range(rounds if len(centres) else 0):
        nearest = (units @ centres.T).argmax(1)
        sums = np.array([units[nearest == c].sum(0) for c in range(len(centres))])
        lengths = np.sqrt((sums ** 2).sum(1))
        centres = np.where(lengths[:, None] > 1e-9, sums / np.maximum(lengths, 1e-9)[:, None], centres)
    return centres


def with_angles(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with their norm and angles, stored in order of the nearest reference and the angle to it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column("vector")).astype(float)
            norms = np.sqrt((whole ** 2).sum(1))
            width = min(whole.shape[1], centres.shape[1])
            cosines = whole[:, :width] @ centres[:, :width].T / np.maximum(norms, 1e-300)[:, None]
            angles = np.arccos(np.clip(np.where(norms[:, None] > 0, cosines, 0), -1, 1)).astype(np.float32)
            places = pa.array(np.arange(len(angles) + 1) * angles.shape[1], pa.int32())
            near = angles.argmin(1) if angles.shape[1] else np.zeros(len(angles), int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), batch.column("label"), pa.array(norms),
                 pa.ListArray.from_arrays(places, pa.array(angles.ravel())), batch.column("vector"),
                 pa.array(near.astype(np.int32)), pa.array(angles.min(1, initial=4.0).astype(float))],
                names=["rid", "id", "label", "norm", "angles", "vector", "near", "angle"])

    measured = rows.mapInArrow(measure, f"{ROW}, near int, angle double")
    order = ["near", "angle", "rid"]
    return shared.cut(measured.repartitionByRange(*order).sortWithinPartitions(*order)).drop("near", "angle")


def bounds(norm: np.ndarray, angles: np.ndarray, norms: np.ndarray, strip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of each anchor with any row of a strip."""
    least = np.zeros(len(norm))
    most = np.full(len(norm), np.pi)
    if angles.shape[1]:
        low, high = strip.min(0), strip.max(0)
        least = np.maximum(np.maximum(angles - high, low - angles).max(1) - SLACK, 0)
        most = np.minimum(np.minimum(angles + high, 2 * np.pi - angles - low).min(1) + SLACK, np.pi)
    near, far = np.cos(least) * norm, np.cos(most) * norm
    top = np.where(near > 0, near * norms.max(), near * norms.min())
    bottom = np.where(far > 0, far * norms.min(), far * norms.max())
    margin = 1 + 1e-9 * norm * norms.max()
    return np.floor(bottom - margin), np.ceil(top + margin)


class Best:
    """The best ``keep`` hits of each slot so far; higher scores first, ties by smaller id, null ids last."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.fifth = keep, np.full(slots, np.iinfo(np.int64).min)
        self.hits = [np.zeros(0, np.int64) for _ in range(5)]       # slot, score, no id, id, rid

    def add(self, *hits: np.ndarray) -> None:
        both = [np.concatenate(pair) for pair in zip(self.hits, hits)]
        order = np.lexsort((both[4], both[3], both[2], -both[1], both[0]))
        slot, score, *rest = [b[order] for b in both]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        self.hits = [b[rank < self.keep] for b in (slot, score, *rest)]
        last = rank == self.keep - 1
        self.fifth[slot[last]] = score[last]


def _scan(anchors: dict, keep: int, same: bool) -> Callable:
    """A scan of stored rows for the anchors' windows.

    ``anchors``: rid, label, norm, angles, matrix; windows of slots: anchor (index), low, high, in order of anchors.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors
        best = Best(len(a["anchor"]), keep)
        for batch in batches:
            label = batch.column("label").to_numpy()
            rid = batch.column("rid").to_numpy()
            no_id = batch.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column("id").fill_null(0).to_numpy()
            norm = batch.column("norm").to_numpy()
            matrix = _matrix(batch.column("vector"))
            angles = _angles(batch)
            for at in range(0, len(norm), STRIP):
                rows = slice(at, at + STRIP)
                lowest, highest = bounds(a["norm"], a["angles"], norm[rows], angles[rows])
                floor = np.maximum(a["low"], best.fifth)
                slots = np.flatnonzero((highest[a["anchor"]] >= floor) & (lowest[a["anchor"]] <= a["high"]))
                if not len(slots):
                    continue
                wanted, where = np.unique(a["anchor"][slots], return_inverse=True)
                found = scores(a["matrix"][wanted], matrix[rows])
                fits = (a["label"][wanted, None] == label[None, rows]) == same
                fits &= a["rid"][wanted, None] != rid[None, rows]
                hit = fits[where] & (found[where] >= floor[slots, None]) & (found[where] <= a["high"][slots, None])
                slot, row = np.nonzero(hit)
                if len(slot):
                    best.add(slots[slot], found[where[slot], row], no_id[rows][row], ids[rows][row], rid[rows][row])
        slot, score, no_id, ids, rid = best.hits
        yield pa.RecordBatch.from_arrays(
            [pa.array(a["rid"][a["anchor"][slot]]), pa.array(a["slot"][slot]), pa.array(score),
             pa.array(ids, mask=no_id.astype(bool)), pa.array(rid)], names=["anchor", "slot", "score", "id", "rid"])

    return scan


def _search(stored: DataFrame, anchors: dict, keep: int, same: bool) -> DataFrame:
    """The best ``keep`` rows of every slot with their rank, merged from all tasks."""
    sent = stored.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches):
        yield from _scan(sent.value, keep, same)(batches)

    found = stored.mapInArrow(scan, "anchor long, slot int, score long, id long, rid long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, anchor_every: int = 100, low: int = 80, high: int = 100, keep: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the ids divisible by ``anchor_every``.

    Labels move by one, modulo 10, where 7 divides the id; vectors are floors of ``SCALE`` times their components.
    """
    spark = rows.sparkSession
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = prepare(rows, label)
    sample = known.orderBy(F.xxhash64("id", "rid")).limit(SAMPLE).select("vector").toArrow()
    stored = with_angles(known, references(_matrix(sample.column("vector"))))
    asked = shared.cut(stored.where(F.col("id") % anchor_every == 0).select(F.lit(0).alias("all"), "*"))
    widest = asked.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    block = max(1, ANCHOR_BYTES // (8 * ((widest[0] or 0) + REFERENCES + 16)))
    ranged, spans = shared.numbered(asked, ["all"], ["rid"])
    ranged = ranged.join(spans, ["all", "span"]).withColumn("block", F.floor(shared.place(["all"], ["rid"]) / block))
    ranged = shared.cut(ranged.select("block", "rid", "id", "label", "norm", "angles", "vector"))
    pieces = []
    for number in range(-(-widest[1] // block)):
        taken = ranged.where(F.col("block") == number).toArrow().sort_by("rid")
        pieces.append(_block(stored, taken, low, high, keep))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = spark.createDataFrame([], result)
    for piece in pieces:
        whole = whole.union(piece)
    return whole


def _block(stored: DataFrame, taken: pa.Table, low: int, high: int, keep: int) -> DataFrame:
    """The result for a block of anchors: positives of all first, then negatives in the windows these give."""
    n = taken.num_rows
    anchors = {"rid": taken.column("rid").to_numpy(), "label": taken.column("label").to_numpy(),
               "norm": taken.column("norm").to_numpy(), "matrix": _matrix(taken.column("vector")),
               "angles": _angles(taken)}
    ends = np.iinfo(np.int64)
    every = {"anchor": np.arange(n), "slot": np.zeros(n, np.int32), "low": np.full(n, ends.min), "high": np.full(n, ends.max)}
    positives = shared.cut(_search(stored, anchors | every, keep, True))
    # At most ``keep`` rows for each anchor of the block.
    known = positives.select("anchor", "rank", "score").toArrow().sort_by([("anchor", "ascending"), ("rank", "ascending")])
    score = known.column("score").to_pylist()
    windows = {"anchor": np.searchsorted(anchors["rid"], known.column("anchor").to_numpy()),
               "slot": known.column("rank").to_numpy().astype(np.int32),
               "low": np.array([-(-low * s // 100) for s in score], np.int64),
               "high": np.array([high * s // 100 for s in score], np.int64)}
    negatives = _search(stored, anchors | windows, keep, False).select(
        "anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
    ids = stored.sparkSession.createDataFrame(taken.select(["rid", "id"]).rename_columns(["anchor", "anchor_id"]))
    return shared.cut(negatives.join(named, ["anchor", "slot"]).join(ids, "anchor")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
