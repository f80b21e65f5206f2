"""Exact Jaccard self-join of documents on word shingles by universe partitioning.

Two sets with similarity of at least p / 100 and sizes up to ``u`` differ in at most
H = 2u (100 - p) / (100 + p) shingles. Sizes fall into bands; a band hashes the universe of shingles into ``m``
segments, so a pair of a band that differs in at most H shingles agrees in at least one of any H + 1 segments that
one of the two fills. A set emits one signature per filled segment for its own band, and for the next band if a
partner there is possible (there, H + ``SHARED`` segments are enough). Segments get one of three allocations by cost:

* 0: shingles that are frequent in a bounded sample take no part, so passages that many documents share
  make no candidates (differing less in the rest, a pair still agrees somewhere). A set with too few other
  shingles, or with a possible partner that has too few, also emits signatures over its whole set, of the segments
  with a shingle that is not frequent; of the others too only if those are not more than H;
* 1: the sum of a segment's shingles, compared for equality; ``m`` is large enough that practically every set
  fills H + 1 segments;
* 2: one-deletion neighbourhoods of the whole set where H is 1, the cheapest cover there.

Bands in which some set fills fewer than H + 1 segments are noted; they are hashed once more into four times as
many segments, and so on, until every set fills enough of some partition. Sets of one band with H = 0 can only be equal.

A set that sends ``s`` segments shares at least s - H of them, or ``SHARED``, with a similar one. Sets that share fewer
with all others together leave, and so on with what is left, so a shingle that unrelated texts share by chance makes no
candidates. Without that, their number grew with the square of the documents.

Equal sets form a class, and everything below is between classes. Signatures of one class are dropped. A signature
puts its classes under the smallest one, their leader. Each class is first verified on the texts against one leader,
that of the most of its groups, and linked classes form components. Only groups that then hold several components go
on: members are verified against a leader of another component, and where components still differ, those outside one
of them are compared with all members, block by block in the tasks. So a group of near copies costs a few comparisons
per member, while no link is lost: within a component no further one is needed.

Texts are shipped only for classes that a sketch cannot tell apart. The sketch of a set counts its shingles in about as
many buckets as there are shingles, in half a byte each. Bucket counts of two sets differ by at most as much as the
sets do, also where a count stops at 15 and where buckets are added up, so only pairs below the threshold are put off.

A text without words, or null, has an empty set and is linked with nothing. Fewer words than a shingle are one
shingle. Repeated rows are one class. Empty tables give no rows. Texts are processed whole; only the id and text
columns are read. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import arrays, shared
from sourceloom.llm.components import components

SAMPLE_DOCS = 20_000       # documents in which frequent shingles are looked for; any set of them is right
FREQUENT_BITS = 22
BLOCK_MEMBERS = 512        # classes on either side of a comparison of blocks
PRODUCT_SHINGLES = 4096    # shingles counted at once there
FINE = 4                   # times as many segments for whole sets, so that frequent shingles fill few of the sent ones
LARGEST = 1 << 24          # shingles in the largest band; larger sets share it
SHARED = 16                # signatures that a set must share with others, if it sends so many more than H

_U = np.uint64


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    least: int             # smallest partner of a set of the band
    differ: int            # H
    segments: int
    enough: int            # shingles outside the frequent ones from which these suffice


def _segments(tokens: int, needed: int) -> int:
    """Smallest number of segments of which ``tokens`` random shingles fill ``needed`` (five deviations away)."""
    m = needed
    while m < 64 * tokens:
        load = tokens / m
        filled = m * (1 - math.exp(-load))
        spread = math.sqrt(max(m * math.exp(-load) * (1 - (1 + load) * math.exp(-load)), 0))
        if filled - 5 * spread >= needed:
            break
        m = max(m + 1, m * 21 // 20)
    return m


def bands(percent: int) -> list[Band]:
    if not 70 <= percent <= 100:
        raise ValueError("percent must be 70 to 100: below, a set may have no more shingles than a pair may differ in")
    t = percent / 100
    ratio = min(max(t * t, 2.5 * (1 - t) / (t * (1 + t))), t)
    out, low = [], 1
    while low <= LARGEST:
        high = max(low, math.ceil(low / ratio) - 1)
        differ = 2 * high * (100 - percent) // (100 + percent)
        least = -(-low * percent // 100)
        enough = max(least * 9 // 10, 1)
        out.append(Band(low, high, least, differ, _segments(enough, differ + 1) if differ > 1 else 1, enough))
        low = high + 1
    return out


class Sets:
    """Sorted shingle sets of the rows of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        words = arrays.Words(data, offsets, lower=True)
        prefix = arrays.Prefix(words.hashes)
        grams = prefix.windows(k)
        sets = []
        for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist()):
            if b - a >= k:
                sets.append(np.unique(grams[a:b - k + 1]))
            else:
                sets.append(prefix.spans(np.array([a]), np.array([b])) if b > a else np.zeros(0, _U))
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, _U)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    @property
    def classes(self) -> np.ndarray:
        """64-bit id of each set: equal for equal sets."""
        sums = np.zeros(len(self.sets), _U)
        filled = self.sizes > 0
        if filled.any():
            values = arrays.mix(self.flat + _U(0x632BE59BD9B4E019))
            sums[filled] = np.add.reduceat(values, self.bounds[:-1][filled])
        return arrays.mix(sums ^ arrays.mix(self.sizes.astype(_U))).view(np.int64)


    def sketches(self) -> pa.Array:
        """Bucket counts of each set, two to a byte."""
        bits = sketch_bits(self.sizes)
        base = np.concatenate([[0], np.cumsum(1 << bits)])
        job = np.repeat(np.arange(len(self.sets)), self.sizes)
        slot = (self.flat >> (64 - bits[job]).astype(_U)).astype(np.int64) + base[job]
        counts = np.minimum(np.bincount(slot, minlength=base[-1]), 15).astype(np.uint8)
        packed = counts[0::2] | (counts[1::2] << 4)
        return pa.Array.from_buffers(pa.large_binary(), len(self.sets), [
            None, pa.py_buffer(base // 2), pa.py_buffer(packed)]).cast(pa.binary())


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Logarithm of the number of buckets: the largest power of two that is no more than the size (2 at least)."""
    return np.maximum(np.frexp(np.maximum(sizes, 1))[1] - 1, 1).astype(np.int64)


def buckets(sketches: list[bytes], bits: int) -> np.ndarray:
    """Counts of sketches of one length, added up to ``2 ** bits`` buckets (of at most twice as many)."""
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    counts = np.empty((len(sketches), 2 * packed.shape[1]), np.uint8)
    counts[:, 0::2], counts[:, 1::2] = packed & 15, packed >> 4
    return counts if counts.shape[1] == 1 << bits else counts[:, 0::2] + counts[:, 1::2]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)


def may_link(percent: int, apart: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False where sets of sizes ``n`` and ``m`` that differ by ``apart`` or more cannot be similar enough."""
    return (apart * (100 + percent) <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _jobs(sizes: np.ndarray, percent: int, table: list[Band]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, own) of every band that a set takes part in; own: the band its size lies in."""
    lows = np.array([b.low for b in table])
    own = np.minimum(np.searchsorted(lows, sizes, side="right") - 1, len(table) - 1)
    rows = np.flatnonzero(sizes > 0)
    own = own[rows]
    after = np.minimum(own + 1, len(table) - 1)
    up = (after > own) & (100 * sizes[rows] >= percent * lows[after])
    row, band = np.concatenate([rows, rows[up]]), np.concatenate([own, own[up] + 1])
    open_ = np.array([b.differ for b in table])[band] > 0
    return row[open_], band[open_], (np.arange(len(row)) < len(rows))[open_]


def signatures(sets: Sets, percent: int, table: list[Band], frequent: np.ndarray,
               finer: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of every allocated segment, bands in which some set fills too few, and for every set how many
    of its signatures any similar set has."""
    rows, bands_, owns = _jobs(sets.sizes, percent, table)
    need = np.full(len(sets.sizes), SHARED, np.int64)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), need
    differ, segments, enough, least = (np.array([getattr(b, c) for b in table])
                                       for c in ("differ", "segments", "enough", "least"))
    factor = np.ones(len(table), np.int64)
    for band, f in finer.items():
        factor[band] = f
    rare = ~frequent[(sets.flat >> _U(64 - FREQUENT_BITS)).astype(np.int64)]
    n_rare = np.add.reduceat(np.append(rare, False).astype(np.int64), np.minimum(sets.bounds[:-1], len(rare)))
    n_rare[sets.sizes == 0] = 0
    h, n, e = differ[bands_], n_rare[rows], enough[bands_]
    # A partner below ``enough`` has at most e - 1 rare shingles and at least least - e + 1 others.
    nearest = n - e + 1 + np.maximum(least[bands_] - e + 1 - (sets.sizes[rows] - n), 0)
    whole = (n < e) | (nearest <= h) | (h == 1)
    part = (n >= e) & (h > 1)
    kinds = [np.flatnonzero(part), np.flatnonzero(whole), np.flatnonzero((factor[bands_] > 1) & (h > 1))]
    values = arrays.mix(sets.flat)
    out_rows, out_sigs = [], []
    poor = np.zeros(len(rows), bool)
    for kind, jobs in enumerate(kinds):
        if not len(jobs):
            continue
        row, band, own = rows[jobs], bands_[jobs], owns[jobs]
        at = arrays.ranges(sets.bounds[row], sets.sizes[row])
        job = np.repeat(np.arange(len(jobs)), sets.sizes[row])
        if kind == 0:
            keep = rare[at]
            at, job = at[keep], job[keep]
        m = segments[band] * (1, np.where(differ[band] > 1, FINE, 1), factor[band])[kind]
        token = values[at]
        label = arrays.mix((band.astype(_U) << _U(8)) | _U(kind))
        local = ((arrays.mix(token ^ label[job]) >> _U(11)) % m[job].astype(_U)).astype(np.int64)
        # Sum of each filled segment; jobs have their segments one after the other.
        base = np.concatenate([[0], np.cumsum(m)])
        used, slot = np.unique(base[job] + local, return_inverse=True)
        sums = np.zeros(len(used), _U)
        np.add.at(sums, slot, token)
        owner = np.searchsorted(base, used, side="right") - 1
        place = label[owner] + (used - base[owner]).astype(_U)
        count = np.bincount(owner, minlength=len(jobs))
        poor[jobs] = (count < differ[band] + 1) & (differ[band] > 1) if kind < 2 else poor[jobs] & (count < differ[band] + 1)
        # H + 1 segments with a shingle that is not frequent are enough: one of them agrees, and the partner, which
        # has that shingle too, sends it as well. Only sets with fewer of them send the others.
        held = np.zeros(len(used), bool)
        held[slot[rare[at]]] = True
        n_held = np.bincount(owner, held, len(jobs)).astype(np.int64)
        few = n_held <= differ[band]
        # At most H of the held ones are not the partner's; a set with few of them may share a single segment.
        np.minimum.at(need, row, np.maximum(n_held - differ[band], 1))
        # A visitor from the band below meets sets of the band only: H + SHARED of its segments are enough.
        number = np.empty(len(used), np.int64)
        number[np.lexsort((~held, owner))] = np.arange(len(used)) - np.searchsorted(owner, owner)
        sent = np.flatnonzero((held | few[owner]) & (own[owner] | (number < differ[band[owner]] + SHARED)))
        out_rows.append(row[owner[sent]])
        out_sigs.append(arrays.mix(sums[sent] ^ arrays.mix(place[sent])))
        one = np.flatnonzero(differ[band[job]] == 1)
        if len(one):                                # the set without one shingle, for every shingle
            out_rows.append(row[job[one]])
            out_sigs.append(arrays.mix((sums[slot[one]] - token[one]) ^ arrays.mix(label[job[one]])))
    row, sig = np.concatenate(out_rows), (np.concatenate(out_sigs) >> _U(16)).view(np.int64)
    # Signatures of a set that fall together count once.
    order = np.lexsort((sig, row))
    again = (np.diff(row[order]) == 0) & (np.diff(sig[order]) == 0)
    need = np.maximum(need - np.bincount(row[order][1:][again], minlength=len(need)), 1)
    return row, sig, np.unique(bands_[poor]), need


def _slices(batches, k):
    for batch in batches:
        for rows, data, offsets in arrays.slices(batch):
            yield batch, rows, Sets(data, offsets, k)


def _profile(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, sets in _slices(batches, k):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c)[rows.start:rows.stop] for c in (0, 1)), pa.array(sets.classes), pa.array(sets.sizes),
                 sets.sketches()], ["rid", "doc_id", "cls", "n", "sketch"])

    return scan


def _emit(k: int, percent: int, frequent: np.ndarray, finer: dict[int, int]):
    """Signatures of 48 bits (an accident costs one comparison) and how many of its own a class must share; -1 - band
    marks a band with a set that fills too few segments."""
    table = bands(percent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _slices(batches, k):
            row, sig, poor, need = signatures(sets, percent, table, frequent, finer)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([sig, -1 - poor])), pa.array(np.concatenate([sets.classes[row], 0 * poor])),
                 pa.array(np.concatenate([need[row], 0 * poor]).astype(np.int32))], ["sig", "cls", "need"])

    return scan


def _shingles(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _slices(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array((sets.flat >> _U(64 - FREQUENT_BITS)).view(np.int64))], ["slot"])

    return scan


def frequent_slots(docs: DataFrame, k: int, count: int) -> np.ndarray:
    """Hash slots whose shingles recur in a sample of at most about ``SAMPLE_DOCS`` documents."""
    sample = docs.where(F.pmod(F.xxhash64("rid"), F.lit(count // SAMPLE_DOCS + 1)) == 0)
    often = max(12, min(count, SAMPLE_DOCS) // 500)
    slots = shared.cut(sample.select("text").mapInArrow(_shingles(k), "slot long").groupBy("slot").count()
                       .where(F.col("count") >= often).select("slot")).toPandas()["slot"]      # at most 2^22 rows
    found = np.zeros(1 << FREQUENT_BITS, bool)
    found[slots.to_numpy(np.int64)] = True
    return found


def _verify(k: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            known: dict[int, np.ndarray] = {}
            left_ids = batch.column(0).to_pylist()
            others = [s for _, _, sets in _slices([batch.select(["text_b"]).rename_columns(["text"])], k) for s in sets.sets]
            leaders = batch.column(2)
            for i, a in enumerate(left_ids):
                if a not in known:
                    if len(known) > 1000:
                        known.clear()
                    text = (leaders[i].as_py() or "").encode()
                    known[a] = Sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), k).sets[0]
                x, y = known[a], others[i]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scan


def _sketched(percent: int):
    """Pairs that their sketches do not tell apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            bits = np.minimum(sketch_bits(na), sketch_bits(nb)).tolist()
            apart = np.array([distances(buckets([a], b), buckets([c], b))[0] for a, c, b in zip(
                batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), bits)], np.int64)
            yield batch.select(["a", "ra", "b", "rb"]).filter(pa.array(may_link(percent, apart, na, nb)))

    return scan


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, ra, b, rb) whose texts are similar enough; ra and rb are keys of a text of the class."""
    texts = docs.select("rid", "text")
    half = pairs.join(texts.select(F.col("rid").alias("rb"), F.col("text").alias("text_b")), "rb")
    full = half.join(texts.select(F.col("rid").alias("ra"), F.col("text").alias("text_a")), "ra")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, percent), "a long, b long").distinct()


def _blocks(k: int, percent: int):
    """Similar pairs between the outer and all members of a block pair, thinned to those that join components."""

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [s for _, _, x in _slices(table.select(["text"]).to_batches(), k) for s in x.sets]
        sizes = np.array([len(s) for s in sets], np.float32)
        outer = table["outer"].to_numpy(zero_copy_only=False).astype(bool)
        cls, root = table["cls"].to_numpy(), table["root"].to_numpy()
        # Shingles of one member decide nothing; the rest is counted by one product over the shared ones.
        flat = np.concatenate(sets)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        member = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        left, right = np.flatnonzero(outer), np.flatnonzero(~outer)
        both = np.zeros((len(left), len(right)), np.float32)
        rank = np.cumsum(times > 1) - 1
        used = times[code] > 1
        code, member = rank[code[used]], member[used]
        total = int(rank[-1]) + 1 if len(rank) else 0
        for first in range(0, total, PRODUCT_SHINGLES):
            part = (code >= first) & (code < first + PRODUCT_SHINGLES)
            holds = np.zeros((len(sets), min(PRODUCT_SHINGLES, total - first)), np.float32)
            holds[member[part], code[part] - first] = 1
            both += holds[left] @ holds[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        near = (100 * both.astype(np.float64) >= percent * union.astype(np.float64)) & (both > 0)
        near &= root[left][:, None] != root[right][None, :]
        x, y = np.nonzero(near)
        x, y = left[x], right[y]
        _, once = np.unique(np.stack([root[x], root[y]]), axis=1, return_index=True)
        return pa.table({"a": np.minimum(cls[x], cls[y])[once], "b": np.maximum(cls[x], cls[y])[once]})

    return group


def _sketched_blocks(percent: int):
    """Members of a block pair with a partner in another component from which their sketch does not tell them apart."""

    def group(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        outer = table["outer"].to_numpy(zero_copy_only=False).astype(bool)
        sketches, n, root = table["sketch"].to_pylist(), table["n"].to_numpy(), table["root"].to_numpy()
        bits = sketch_bits(n)
        found = np.zeros(len(n), bool)
        for a in np.unique(bits[outer]):
            for b in np.unique(bits[~outer & (np.abs(bits - a) <= 1)]):     # sizes of a link differ by less than twice
                left, right = np.flatnonzero(outer & (bits == a)), np.flatnonzero(~outer & (bits == b))
                common = int(min(a, b))
                theirs = buckets([sketches[i] for i in right], common)
                for i in left:
                    other = np.flatnonzero((root[right] != root[i]) & may_link(percent, np.zeros(1), n[i], n[right]))
                    if len(other):
                        apart = distances(theirs[other], buckets([sketches[i]], common))
                        near = right[other[may_link(percent, apart, n[i], n[right[other]])]]
                        found[near] = True
                        found[i] |= bool(len(near))
        return table.select(["lead", "cls"]).filter(pa.array(found))

    return group


def _placed(named: DataFrame) -> DataFrame:
    """Pairs of blocks (lead, f, g) of the members outside the smallest component and of all members."""
    sizes = shared.cut(named.groupBy("lead").agg(
        F.count(F.lit(1)).alias("all"), F.count_if("outer").alias("far")).where("far > 0 and all > 1")
        .select("lead", F.ceil(F.col("all") / BLOCK_MEMBERS).alias("na"), F.ceil(F.col("far") / BLOCK_MEMBERS).alias("nf")))
    named = named.join(sizes, "lead")
    far = named.where("outer").select("lead", "cls", "root", F.lit(True).alias("outer"), F.pmod(F.hash("cls"), "nf").alias("f"),
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)).alias("g"))
    all_ = named.select("lead", "cls", "root", F.lit(False).alias("outer"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("nf") - 1)).alias("f"),
                        F.pmod(F.hash("cls"), "na").alias("g"))
    return far.unionByName(all_)


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the members of one leader.

    Members outside the smallest component of their group are compared with all members, in pairs of blocks of
    ``BLOCK_MEMBERS``; no pair is written unless it links two components.
    """
    roots = labels.select(F.col("id").alias("cls"), "root")
    named = members.join(roots, "cls", "left").select("lead", "cls", F.coalesce("root", "cls").alias("root"))
    base = named.groupBy("lead").agg(F.min("root").alias("base"))
    # The leader itself has been compared with every member, or is of its component.
    named = shared.cut(named.join(base, "lead").where("cls <> lead").select(
        "lead", "cls", "root", (F.col("root") != F.col("base")).alias("outer")))
    sketched = _placed(named).join(classes.select("cls", "n", "sketch"), "cls")
    close = sketched.select("lead", "f", "g", "cls", "root", "outer", "n", "sketch").groupBy("lead", "f", "g") \
        .applyInArrow(_sketched_blocks(percent), "lead long, cls long").distinct()
    named = shared.cut(named.join(close, ["lead", "cls"], "left_semi"))
    placed = _placed(named).join(classes.select("cls", "rid"), "cls")
    texts = placed.join(docs.select("rid", "text"), "rid")      # a repeated row repeats a member, which is harmless
    return texts.select("lead", "f", "g", "cls", "root", "outer", "text").groupBy("lead", "f", "g") \
        .applyInArrow(_blocks(k, percent), "a long, b long").distinct()


def grouped(rows: DataFrame) -> DataFrame:
    """(sig, lead, cls, need) of the signatures of several classes, without classes that share too few of them."""
    before = None
    while True:
        ends = shared.cut(rows.groupBy("sig").agg(F.min("cls").alias("lead"), F.max("cls").alias("last"))
                          .where("lead < last").select("sig", "lead"))
        groups = rows.select("sig", "cls", "need").join(ends, "sig")
        now = groups.count()
        if before is not None and 10 * now >= 9 * before:
            return groups
        able = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("cls")
        rows, before = shared.cut(groups.join(able, "cls", "left_semi").select("sig", "cls", "need")), now


def nearest(groups: DataFrame) -> DataFrame:
    """(a, b): every class b and the leader a of the most of its ``groups`` (sig, lead, cls), but for its own."""
    shared_groups = groups.where("lead < cls").groupBy("lead", "cls").agg(F.count(F.lit(1)).alias("n"))
    return shared_groups.groupBy("cls").agg(F.min(F.struct((-F.col("n")).alias("n"), "lead")).alias("most")) \
        .select(F.col("most.lead").alias("a"), F.col("cls").alias("b"))


def unsettled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(lead, lead_root, cls, root) of the groups that hold several components; all pairs of the others are in one."""
    roots = labels.select(F.col("id").alias("cls"), "root")
    named = shared.cut(groups.select("sig", "cls").join(roots, "cls", "left").select("sig", "cls", F.coalesce("root", "cls").alias("root")))
    open_ = named.groupBy("sig").agg(
        F.min("cls").alias("lead"), F.min_by("root", "cls").alias("lead_root"), F.min("root").alias("low"), F.max("root").alias("high")) \
        .where("low < high").select("sig", "lead", "lead_root")
    return named.join(open_, "sig").select("lead", "lead_root", "cls", "root").distinct()


def join(docs: DataFrame, k: int, percent: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rid, doc_id, n_shingles, cls, component, component_id) for every row of ``docs``.

    ``component`` is null for documents without links to a different text; ``component_id`` is the smallest id of
    the documents that links reach (for an empty set: the document's own).
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")) \
        .select(shared.row_key().alias("rid"), "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    frequent = frequent_slots(docs, k, docs.count())
    profile = shared.cut(docs.select("rid", "doc_id", "text").mapInArrow(
        _profile(k), f"rid long, doc_id {id_type}, cls long, n long, sketch binary"))
    classes = shared.cut(profile.where("n > 0").groupBy("cls").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("low_id"), F.max("n").alias("n"), F.first("sketch").alias("sketch")))

    def repeated(finer: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        rows = docs.select("text").mapInArrow(_emit(k, percent, frequent, finer), "sig long, cls long, need int")
        return rows, shared.cut(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or sig < 0").select("sig"))

    finer: dict[int, int] = {}
    while True:
        rows, twice = repeated(finer)
        poor = [-1 - r["sig"] for r in twice.where("sig < 0").collect()]       # band numbers
        if not poor:
            break
        finer |= {band: 4 * finer.get(band, 1) for band in poor}
    groups = grouped(shared.cut(rows.join(twice.where("sig >= 0"), "sig", "left_semi").groupBy("sig", "cls")
                                .agg(F.min("need").alias("need"))))
    links = shared.cut(verified(_with_keys(nearest(groups), classes, percent), docs, k, percent))
    members = shared.cut(unsettled(groups, components(links)))
    links = shared.cut(links.union(verified(_with_keys(
        members.where("root <> lead_root").select(F.col("lead").alias("a"), F.col("cls").alias("b")), classes, percent),
        docs, k, percent)))
    members, labels = members.select("lead", "cls"), components(links)
    late = shared.cut(_across(members, labels, classes, docs, k, percent))
    if late.limit(1).count():
        labels = components(links.union(late))

    named = classes.join(labels.withColumnRenamed("id", "cls"), "cls", "left") \
        .select("cls", F.coalesce("root", "cls").alias("root"), "low_id", F.col("root").alias("component"))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = shared.cut(named.join(lowest, "root").select("cls", "component", "component_id"))
    return profile.join(named, "cls", "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), "cls", "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_keys(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, ra, b, rb) of the pairs whose sizes and sketches allow the similarity."""
    def end(cls: str, *names: str) -> DataFrame:
        return classes.select(*(F.col(c).alias(n) for c, n in zip(("cls", "rid", "n", "sketch"), (cls, *names))))

    both = pairs.join(end("a", "ra", "na", "sa"), "a").join(end("b", "rb", "nb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = both.join(classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sb")), "b")
    return shared.cut(both.select("a", "ra", "na", "sa", "b", "rb", "nb", "sb").mapInArrow(
        _sketched(percent), "a long, ra long, b long, rb long"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (ties: by text hash).

    Equal texts are one component. Texts without words are linked with nothing and all stay.
    """
    found = join(docs, k, percent, id_column, text_column)
    group = F.coalesce("component", "cls")
    best = found.where("n_shingles > 0").groupBy(group.alias("g")).agg(F.min(F.struct("doc_id", "rid")).alias("best"))
    stay = shared.cut(best.select(F.col("best.rid").alias("key"), F.lit(True).alias("one")).union(
        found.where("n_shingles = 0").select("rid", F.lit(False))).distinct())
    rows = docs.select(shared.row_key(id_column, text_column).alias("key"), shared.whole_row(docs)).join(stay, "key")
    single = rows.where("one").dropDuplicates(["key"])
    return single.unionByName(rows.where("not one")).select("row.*")
