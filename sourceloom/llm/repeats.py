"""Repeated windows of a corpus: every run of ``length`` symbols that starts at two places.

The two deduplication operators share this frame and differ in what they sort inside a group
(``suffix_tree``: words, ``bwt_merge``: bytes).

1. *Anchors.* Every window elects its leftmost smallest ``gram``-symbol hash. Equal windows elect the same
   anchor at the same distance, so a window whose anchor hash occurs once in the corpus cannot repeat.
   Consecutive windows with one anchor form a *context*: all symbols those windows touch.
2. *Counting.* Anchors that occur once are dropped. A context that occurs twice is repeated as a whole;
   this is decided by counts alone, which are combined before the shuffle, so a passage or a document with
   any number of copies never gathers in one task.
3. *Resolving.* Only contexts that share an anchor with a different context are left: the edges of
   passages. One representative of each goes to a group by anchor, and the resolver finds the windows that
   occur more than once in it. Anchors with more than ``GROUP_CONTEXTS`` contexts are split over several
   groups; each reports one row per distinct window it could not decide, and a count by window hash joins
   the groups.
4. *Mapping back.* Decided windows are joined to all occurrences and collected per document.

Equality of anchors, contexts and words is that of 64-bit hashes (contexts: of two of them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import arrays, shared

GROUP_CONTEXTS = 2048      # contexts a resolver gets at once, and from which an anchor is split

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)

# resolver(values, context offsets, windows per context, weight per context) -> (windows that repeat)
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class WordSymbols:
    """A symbol is a word; it travels as its 64-bit hash."""

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit value of each symbol, first symbol of each row)."""
        words = arrays.Words(data, offsets)
        return words.hashes, words.rows

    def pack(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What travels of each symbol."""
        return values

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, _U)


class ByteSymbols:
    """A symbol is a byte and travels as itself."""

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return arrays.BYTE_VALUES[data], offsets

    def pack(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        return data

    def unpack(self, raw: bytes) -> np.ndarray:
        return arrays.BYTE_VALUES[np.frombuffer(raw, np.uint8)]


Symbols = WordSymbols | ByteSymbols


def contexts(values: np.ndarray, bounds: np.ndarray, gram: int, length: int):
    """(row, first window, windows, anchor hash, context hash) of every context, as arrays."""
    sizes = np.diff(bounds)
    windows = np.maximum(sizes - length + 1, 0)
    starts = arrays.ranges(bounds[:-1], windows)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    prefix = arrays.Prefix(values)
    grams = prefix.windows(gram)
    keys = (grams & _HIGH) | np.arange(len(grams), dtype=_U)
    anchor = (arrays.sliding_min(keys, length - gram + 1)[starts] & ~_HIGH).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), windows)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], anchor[first]
    distance = (anchor - begin).astype(_U)
    context = arrays.mix(prefix.spans(begin, begin + count - 1 + length) + distance * _U(0xA24BAED4963EE407))
    return row[first], begin - bounds[row[first]], count, grams[anchor], context


def _occurrences(symbols: Symbols, gram: int, length: int):
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("rid", pa.int64()),
                        ("start", pa.int64()), ("windows", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, data, offsets in arrays.slices(batch):
                row, start, count, anchor, context = contexts(*symbols.read(data, offsets), gram, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchor.view(np.int64), context.view(np.int64), rid[rows][row],
                                           start, count)], schema=schema)

    return scan, "anchor long, context long, rid long, start long, windows long"


def _extract(symbols: Symbols, length: int):
    """Symbols of the representative contexts of a row."""
    schema = pa.schema([("bucket", pa.int64()), ("split", pa.bool_()), ("anchor", pa.int64()),
                        ("context", pa.int64()), ("n", pa.int64()), ("windows", pa.int64()),
                        ("symbols", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            # Rows with equal id and text hold the same contexts: the first of a task sends them.
            for i, rid in enumerate(batch.column(0).to_pylist()):
                if rid in done:
                    wanted[i] = None
                done.add(rid)
            for rows, data, offsets in arrays.slices(batch):
                if not any(wanted[rows]):
                    continue
                values, bounds = symbols.read(data, offsets)
                values = symbols.pack(data, values)
                out = [(c["bucket"], c["split"], c["anchor"], c["context"], c["n"], c["windows"],
                        values[bounds[i] + c["start"]:bounds[i] + c["start"] + c["windows"] - 1 + length].tobytes())
                       for i, found in enumerate(wanted[rows]) for c in found or ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return scan, ("bucket long, split boolean, anchor long, context long, n long, windows long, "
                  "symbols binary")


def _resolve(symbols: Symbols, resolver: Resolver, length: int):
    """Ranges of repeated windows per context; for split anchors also the windows still open."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int64()),
                        ("hi", pa.int64()), ("label", pa.int64()), ("weight", pa.int64())])

    def group(table: pa.Table) -> pa.Table:
        # Rows with equal id and text in different tasks report a context twice.
        _, once = np.unique(np.stack([table["anchor"].to_numpy(), table["context"].to_numpy()]), axis=1, return_index=True)
        table = table.take(pa.array(once)).combine_chunks()
        windows = table["windows"].to_numpy()
        weight = table["n"].to_numpy()
        size = windows - 1 + length
        offsets = np.concatenate([[0], np.cumsum(size)])
        values = symbols.unpack(b"".join(table["symbols"].to_pylist()))
        repeated = resolver(values, offsets, windows, weight)
        anchor, context = table["anchor"].to_numpy(), table["context"].to_numpy()
        owner = np.repeat(np.arange(len(windows)), windows)
        local = arrays.ranges(np.zeros(len(windows), np.int64), windows)
        edge = np.ones(len(owner), bool)
        edge[1:] = (repeated[1:] != repeated[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(owner)) - 1
        keep = repeated[first]
        first, last = first[keep], last[keep]
        closed = {"anchor": anchor[owner[first]], "context": context[owner[first]], "lo": local[first],
                  "hi": local[last], "label": None, "weight": None}
        tables = [closed]
        if table["split"][0].as_py():
            labels = arrays.Prefix(values).spans(offsets[owner] + local, offsets[owner] + local + length)
            known, at = np.unique(labels[repeated], return_index=True)
            at = np.flatnonzero(repeated)[at]
            tables.append({"anchor": anchor[owner[at]], "context": context[owner[at]], "lo": -1 - 0 * at,
                           "hi": -1 - 0 * at, "label": known.view(np.int64), "weight": 2 + 0 * at})
            at = np.flatnonzero(~repeated)
            tables.append({"anchor": anchor[owner[at]], "context": context[owner[at]], "lo": local[at],
                           "hi": local[at], "label": labels[at].view(np.int64), "weight": weight[owner[at]]})
        return pa.concat_tables([pa.Table.from_arrays(
            [pa.nulls(len(t["lo"]), f.type) if t[f.name] is None else pa.array(t[f.name], f.type)
             for f in schema], schema=schema) for t in tables])

    return group, "anchor long, context long, lo long, hi long, label long, weight long"


def repeated_windows(docs: DataFrame, symbols: Symbols, resolver: Resolver, gram: int,
                     length: int) -> DataFrame:
    """(rid, lo, hi): inclusive ranges of window starts that repeat. ``docs`` has rid and text.

    The anchor scans read ``docs`` where it lies; only the texts of the edges move, by rid.
    """
    scan, schema = _occurrences(symbols, gram, length)
    found = docs.select("rid", "text").mapInArrow(scan, schema)
    # Written on its own, so that the next join reads two plain exchanges and Spark can split a hot anchor.
    twice = shared.cut(
        found.groupBy("anchor").agg(F.count(F.lit(1)).alias("all")).where("all > 1").select("anchor"))
    found = shared.cut(found.join(twice, "anchor", "left_semi"))

    kinds = found.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start", "windows")).alias("first"))
    kinds = shared.cut(kinds)
    mixed = shared.cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    whole = kinds.where("n > 1").select(
        "anchor", "context", F.lit(0).cast("long").alias("lo"), (F.col("first.windows") - 1).alias("hi"))

    mixed = shared.cut(kinds.join(mixed, "anchor"))
    groups = mixed.count() // (GROUP_CONTEXTS // 2) + 1
    split = F.col("kinds") > GROUP_CONTEXTS
    salts = F.floor(F.col("kinds") / (GROUP_CONTEXTS // 2)) + 1
    picked = mixed.select(
        F.col("first.rid").alias("rid"), F.struct(
            F.when(split, F.xxhash64("anchor", F.pmod("context", salts)))
            .otherwise(F.pmod("anchor", F.lit(groups))).alias("bucket"),
            split.alias("split"), "anchor", "context", "n", F.col("first.start").alias("start"),
            F.col("first.windows").alias("windows")).alias("c"))
    picked = picked.groupBy("rid").agg(F.collect_list("c").alias("wanted"))
    extract, schema = _extract(symbols, length)
    edges = docs.join(picked, "rid", "left").where("wanted is not null").select("rid", "wanted", "text") \
        .mapInArrow(extract, schema)
    group, schema = _resolve(symbols, resolver, length)
    resolved = shared.cut(edges.groupBy("bucket").applyInArrow(group, schema))
    open_ = resolved.where("label is not null")
    met = open_.groupBy("label").agg(F.sum("weight").alias("total")).where("total > 1").select("label")
    late = open_.where("lo >= 0").join(met, "label", "left_semi")
    ranges = whole.unionByName(resolved.where("label is null").select("anchor", "context", "lo", "hi")) \
        .unionByName(late.select("anchor", "context", "lo", "hi"))
    return found.join(ranges, ["anchor", "context"]).select(
        "rid", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def covered(docs: DataFrame, symbols: Symbols, resolver: Resolver, gram: int, length: int,
            id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """(rid, doc_id, text, lo array, hi array) for every row of ``docs``; null arrays: nothing repeats.

    With ``carry`` also ``rest``, a struct of all columns but the text.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column]).alias("rest")] if carry else []
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *rest)
    docs = docs.select(shared.row_key().alias("rid"), *docs.columns)
    # Rows with equal id and text report the same ranges, so a set holds those of one text however often it occurs.
    spans = repeated_windows(docs, symbols, resolver, gram, length).groupBy("rid").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans")) \
        .select("rid", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    return docs.join(spans, "rid", "left")


def cover_mask(size: int, lo: list[int] | None, hi: list[int] | None, length: int) -> np.ndarray:
    """Symbols of one text that lie in a repeated window."""
    change = np.zeros(size + 1, np.int64)
    if lo is not None and len(lo):
        np.add.at(change, np.asarray(lo), 1)
        np.add.at(change, np.minimum(np.asarray(hi) + length, size), -1)
    return np.cumsum(change[:-1]) > 0
