"""Substring deduplication by prefix-partitioned suffix trees over words.

``length`` consecutive words that occur at two places are removed wherever they occur. Suffixes are
partitioned by prefix: the corpus by the anchor gram a window holds (see ``repeats``), a group by as many
leading words as it takes to get parts of at most ``TREE_SUFFIXES`` suffixes. Each part is sorted into the
leaf order of its suffix tree; the common prefixes of neighbours give the internal nodes, and the leaves
below a node of depth ``length`` or more are the repeats.

Null and empty texts have no words and lose nothing. Texts are processed whole. Repeated rows are repeats of
each other; rows with equal id and text get equal results. An empty table gives no rows. Only the id and
text columns are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import arrays, repeats

TREE_SUFFIXES = 4096
GRAM = 8


def prefix_parts(codes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """(suffixes, shared prefix length) of parts with at most ``limit`` suffixes, if any prefix splits them.

    A prefix grows word by word only where a part is still too large; small neighbours share a part.
    """
    pending = [(np.arange(len(codes)), 0)]
    while pending:
        members, depth = pending.pop()
        if len(members) <= limit or depth == codes.shape[1]:
            yield members, depth
            continue
        order = members[np.argsort(codes[members, depth], kind="stable")]
        cuts = np.flatnonzero(np.diff(codes[order, depth])) + 1
        bounds = np.concatenate([[0], cuts, [len(order)]])
        begin = 0
        for i in range(1, len(bounds)):
            alone = bounds[i] - bounds[i - 1] > limit
            if alone and bounds[i - 1] > begin:
                yield order[begin:bounds[i - 1]], depth
                begin = bounds[i - 1]
            if alone:
                pending.append((order[begin:bounds[i]], depth + 1))
                begin = bounds[i]
            elif i + 1 == len(bounds) or bounds[i + 1] - begin > limit:
                yield order[begin:bounds[i]], depth
                begin = bounds[i]


def leaf_order(codes: np.ndarray, members: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a part in tree order, and the common prefix of each with the one before (first: 0)."""
    rest = codes[members, depth:]
    order = np.lexsort(rest.T[::-1]) if rest.shape[1] else np.arange(len(members))
    rest = rest[order]
    same = np.ones((len(members), rest.shape[1] + 1), bool)
    same[1:, :-1] = rest[1:] == rest[:-1]
    same[:, -1] = False
    common = np.argmin(same, axis=1) + depth
    common[0] = 0
    return members[order], common


def deep_nodes(common: np.ndarray, length: int) -> np.ndarray:
    """Node number of each leaf, counting the maximal nodes of depth ``length`` or more (and lone leaves)."""
    return np.cumsum(common < length)


def resolve(length: int, limit: int = TREE_SUFFIXES):
    def resolver(values, offsets, windows, weight):
        _, codes = np.unique(values, return_inverse=True)
        start = arrays.ranges(offsets[:-1], windows)
        suffixes = np.lib.stride_tricks.sliding_window_view(codes.astype(np.int32), length)[start]
        weights = np.repeat(weight, windows)
        repeated = np.zeros(len(start), bool)
        for members, depth in prefix_parts(suffixes, limit):
            leaves, common = leaf_order(suffixes, members, depth)
            node = deep_nodes(common, length)
            repeated[leaves] = np.bincount(node, weights[leaves])[node] > 1
        return repeated

    return resolver


def _apply(length: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for rows, data, offsets in arrays.slices(batch):
                words = arrays.Words(data, offsets)
                out = []
                for i, (a, b) in enumerate(zip(lo[rows], hi[rows])):
                    first, last = words.rows[i], words.rows[i + 1]
                    kept = ~repeats.cover_mask(last - first, a, b, length)
                    at = first + np.flatnonzero(kept)
                    text = b" ".join([data[s:e].tobytes() for s, e in zip(words.starts[at], words.ends[at])])
                    out.append((last - first, last - first - len(at), text, hashlib.sha256(text).hexdigest()))
                n_words, n_removed, text, digest = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start:rows.stop], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(text, pa.binary()).cast(pa.string()), pa.array(digest),
                     *(c[rows.start:rows.stop] for c in batch.columns[4:])],
                    ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", *batch.schema.names[4:]])

    return apply


def remove_repeats(docs: DataFrame, length: int = 35, id_column: str = "doc_id", text_column: str = "text",
                   carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256): ``kept_text`` is the kept words joined by one blank.

    With ``carry`` also the ``text`` as it was and ``rest``, a struct of the other columns.
    """
    found = repeats.covered(docs, repeats.WordSymbols(), resolve(length), min(GRAM, length), length,
                            id_column, text_column, carry)
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, " \
             "kept_text string, kept_sha256 string"
    columns = [F.col(c) for c in ("doc_id", "text", "lo", "hi")]
    if carry:
        columns += [F.col("text").alias("was"), F.col("rest")]
        schema += f", was string, rest {found.schema['rest'].dataType.simpleString()}"
    return found.select(*columns).mapInArrow(_apply(length), schema)


def without_repeats(docs: DataFrame, length: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with shortened texts and their columns. A text without repeats stays as it is, blanks and lines
    included; a document of which nothing is left goes."""
    done = remove_repeats(docs, length, id_column, text_column, carry=True).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("was"))
    return done.select(*[text.alias(c) if c == text_column else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
