"""Substring deduplication over bytes by merging Burrows-Wheeler transforms.

``length`` consecutive bytes that occur at two places are removed wherever they occur. Contexts that share
an anchor (see ``repeats``) form a group; the group is cut into shards, each shard is suffix-sorted alone
and gives a transform, and the shards are merged by refining their interleave: one pass over the
transforms turns an order by ``h`` symbols into an order by ``h + 1``, so no suffix is compared with one of
another shard. A boundary that appears in pass ``h`` marks a common prefix of ``h - 1`` symbols; what is
still one block after the last pass is a repeated interval.

A symbol is a block of ``block`` bytes (a suffix continues ``block`` bytes later), so ``length`` bytes are
``length / block`` passes instead of ``length``; every byte position still is a suffix of its own.

Null and empty texts have no bytes and lose nothing. Texts are processed whole. Repeated rows are repeats of
each other. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sourceloom.llm import arrays, repeats

SHARD_CONTEXTS = 512
BLOCK = 40
GRAM = 40


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable sort of non-negative 32-bit symbols by two counting passes of 16 bits."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    high = (symbols >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def block_symbols(values: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
    """Symbol at each position: the number of its ``block`` values, or 0 where fewer are left.

    A context of n values has n + 1 positions, the last for its empty suffix.
    """
    symbols = np.zeros(len(values) + len(offsets) - 1, np.int64)
    full = np.maximum(np.diff(offsets) - block + 1, 0)
    hashes = arrays.Prefix(values).windows(block)[arrays.ranges(offsets[:-1], full)]
    at = arrays.ranges(offsets[:-1] + np.arange(len(full)), full)
    symbols[at] = np.unique(hashes, return_inverse=True)[1] + 1
    return symbols


def shard_transform(symbols: np.ndarray, first: int, last: int, starts: np.ndarray,
                    block: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform of positions first..last-1 by doubling. ``starts``: context begin of each.

    A suffix ends at its first symbol 0; ends are ordered by position, as if each had a mark of its own.
    """
    own = symbols[first:last]
    size = last - first
    ends = own == 0
    rank = own + np.count_nonzero(ends)
    rank[ends] = np.arange(np.count_nonzero(ends))
    reach = block
    while True:
        follow = np.zeros(size, np.int64)
        if reach < size:
            follow[:-reach] = rank[reach:]
        # A rank below the number of ends, or of an already single suffix, is decided and ignores the rest.
        key = rank * (int(rank.max()) + 2) + follow
        key[ends] = rank[ends] * (int(rank.max()) + 2)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(size, np.int64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        dense = np.cumsum(new) - 1
        if dense[-1] == size - 1:
            break
        rank = np.empty(size, np.int64)
        rank[order] = dense
        ends = _single(dense, order, size) | ends
        reach *= 2
    before = order + first - block
    transform = np.where(before >= starts[order + first], symbols[np.maximum(before, 0)], 0)
    return order + first, transform


def _single(dense: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    alone = np.zeros(size, bool)
    alone[order] = np.bincount(dense)[dense] == 1
    return alone


def merge(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards after ``passes`` refinements.

    Returns the shard of each merged suffix, its block, and the common prefix (in symbols, at most
    ``passes``) with the suffix before it.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    block = np.zeros(len(shard), np.int64)
    common = np.full(len(shard), passes, np.int64)
    seen = np.zeros(len(shard), bool)
    for h in range(passes):
        merged = np.empty(len(shard), np.int64)
        merged[np.argsort(shard, kind="stable")] = symbols
        order = stable_order(merged)
        shard, merged, old = shard[order], merged[order], block[order]
        edge = np.ones(len(shard), bool)
        edge[1:] = (merged[1:] != merged[:-1]) | (old[1:] != old[:-1]) | (merged[1:] == 0)
        common[edge & ~seen] = h
        seen |= edge
        block = np.cumsum(edge) - 1
    return shard, block, common


def resolve(length: int, block: int = BLOCK, shard_contexts: int = SHARD_CONTEXTS):
    if length % block:
        raise ValueError("length must be a multiple of block")

    def resolver(values, offsets, windows, weight):
        symbols = block_symbols(values, offsets, block)
        offsets = offsets + np.arange(len(offsets))
        starts = np.repeat(offsets[:-1], np.diff(offsets))
        cuts = [*range(0, len(windows), shard_contexts), len(windows)]
        shards = [shard_transform(symbols, int(offsets[a]), int(offsets[b]), starts, block)
                  for a, b in zip(cuts, cuts[1:])]
        shard, interval, _ = merge([t for _, t in shards], length // block)
        suffix = np.empty(len(shard), np.int64)
        suffix[np.argsort(shard, kind="stable")] = np.concatenate([s for s, _ in shards])
        mass = np.zeros(len(symbols), np.int64)
        start = arrays.ranges(offsets[:-1], windows)
        mass[start] = np.repeat(weight, windows)
        total = np.bincount(interval, mass[suffix])
        repeated = np.empty(len(symbols), bool)
        repeated[suffix] = total[interval] > 1
        return repeated[start]

    return resolver


def remove_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): ``kept`` is the rest, as bytes."""
    block = next(b for b in range(min(BLOCK, length), 0, -1) if length % b == 0)
    found = repeats.covered(docs, repeats.ByteSymbols(), resolve(length, block), min(GRAM, length), length,
                            id_column, text_column)
    id_type = found.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for rows, data, offsets in arrays.slices(batch):
                out = []
                for i, (a, b) in enumerate(zip(lo[rows], hi[rows])):
                    raw = data[offsets[i]:offsets[i + 1]]
                    gone = repeats.cover_mask(len(raw), a, b, length)
                    kept = raw[~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                    out.append((len(raw), len(raw) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
                n_bytes, n_removed, n_spans, kept, digest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start:rows.stop], pa.array(n_bytes, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                     pa.array(kept, pa.binary()), pa.array(digest)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return found.select("doc_id", "text", "lo", "hi").mapInArrow(
        apply, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
