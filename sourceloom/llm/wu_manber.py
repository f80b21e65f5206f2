"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test items are cut into windows of ``window`` words. A table over blocks of ``BLOCK`` words says how far the
search may jump; where it says 0, the bucket of the window's hash selects test strings, which are compared
word for word. All stripes of a slice of text are searched in step, so a jump costs a few array operations.
Items with fewer words are patterns of their own length and are searched length by length.

Test strings are sent to the tasks in blocks of at most about ``BLOCK_BYTES`` of text (counted first); a larger
benchmark takes several passes over the documents, whose hits are joined by document.

A null or empty text has no words and no hits. A null item text gives no pattern, a null item id counts as ''.
Texts are processed whole; overlapping hits count once. Repeated document rows get equal results, repeated
items count once by id. Empty tables give no rows, or rows without hits. Only id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import arrays, shared

BLOCK = 3
BLOCK_BYTES = 8 << 20
TABLE_BITS = 18
STRIPE = 64


class Patterns:
    """Shift table and buckets of patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.length = length
        self.block = min(BLOCK, length)
        self.items = patterns
        joined = list(patterns)
        text = np.frombuffer(b"".join(joined), np.uint8)
        words = arrays.Words(text, np.concatenate([[0], np.cumsum([len(p) for p in joined])]), arrays.IS_PUNCTUATION)
        prefix = arrays.Prefix(words.hashes)
        first = words.rows[:-1]
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int64)
        blocks = prefix.windows(self.block)
        for j in range(length - self.block + 1):
            np.minimum.at(self.shift, self._slot(blocks[first + j]), length - self.block - j)
        hashes = prefix.spans(first, first + length)
        self.buckets = defaultdict(list)
        for h, p in zip(hashes.tolist(), joined):
            self.buckets[h].append(p)
        self.known = np.sort(hashes)

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: arrays.Words, prefix: arrays.Prefix) -> Iterator[tuple[int, bytes]]:
        """(first word, pattern) of every occurrence inside a row."""
        windows = np.maximum(np.diff(words.rows) - self.length + 1, 0)
        stripes = -(-windows // STRIPE)
        number = arrays.ranges(np.zeros(len(stripes), np.int64), stripes)
        at = np.repeat(words.rows[:-1], stripes) + number * STRIPE
        end = np.minimum(at + STRIPE, np.repeat(words.rows[:-1] + windows, stripes))
        if not len(at):
            return
        jump = self.shift[self._slot(prefix.windows(self.block))]
        last = self.length - self.block            # a window is judged by the block at its end
        found = []
        while len(at):
            step = jump[at + last]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            open_ = at < end
            at, end = at[open_], end[open_]
        at = np.concatenate(found)
        hashes = prefix.spans(at, at + self.length)
        where = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        likely = self.known[where] == hashes
        for i, h in zip(at[likely].tolist(), hashes[likely].tolist()):
            text = b" ".join(words.data[s:e].tobytes() for s, e in
                             zip(words.starts[i:i + self.length], words.ends[i:i + self.length])) + b" "
            if text in self.buckets[h]:
                yield i, text


def build(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    """Patterns of (item id, text) pairs by length. A pattern is its words, each followed by a blank."""
    by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = arrays.Words(raw, np.array([0, len(raw)]), arrays.IS_PUNCTUATION, lower=True)
        parts = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
        size = min(window, len(parts))
        for i in range(len(parts) - size + 1 if size else 0):
            by_length[size][b" ".join(parts[i:i + size]) + b" "].add(item)
    return [Patterns(n, p) for n, p in sorted(by_length.items())]


def _scan(items: list[tuple[str, str]], window: int):
    names_of = ["rid", "doc_id", "n_words", "lo", "hi", "items"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = build(items, window)
        for batch in batches:
            for rows, data, offsets in arrays.slices(batch):
                words = arrays.Words(data, offsets, arrays.IS_PUNCTUATION, lower=True)
                prefix = arrays.Prefix(words.hashes)
                lo, hi, names = defaultdict(list), defaultdict(list), defaultdict(set)
                for p in patterns:
                    for at, text in p.search(words, prefix):
                        row = int(np.searchsorted(words.rows, at, side="right")) - 1
                        lo[row].append(at - int(words.rows[row]))
                        hi[row].append(at - int(words.rows[row]) + p.length)
                        names[row] |= p.items[text]
                count = range(rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[rows.start:rows.stop] for c in (0, 1)), pa.array(np.diff(words.rows)),
                     pa.array([lo[i] for i in count], pa.list_(pa.int64())),
                     pa.array([hi[i] for i in count], pa.list_(pa.int64())),
                     pa.array([sorted(names[i]) for i in count], pa.list_(pa.string()))], names_of)

    return scan


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(rid, doc_id, n_words, lo, hi, items) per row of (rid, doc_id, text): hit word ranges [lo, hi), item ids."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    passes = size // BLOCK_BYTES + 1
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for number in range(passes):
        block = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number)
        one = docs.select("rid", "doc_id", "text").mapInArrow(
            _scan([(r["item"], r["text"]) for r in block.collect()], window),
            f"rid long, doc_id {id_type}, n_words long, lo array<long>, hi array<long>, items array<string>")
        found = one if found is None else found.unionByName(one)
    if passes == 1:
        return found
    # Rows that share rid hold one text, so their hits are equal and repeating them changes nothing. A set has no
    # order, so the two ends of a range travel as one value.
    merged = found.groupBy("rid").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("lo", "hi")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")) \
        .select("rid", "n_words", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"), "items")
    return docs.select("rid", "doc_id").join(merged, "rid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """(rid, doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) for every row of ``docs``."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")) \
        .select(shared.row_key().alias("rid"), "doc_id", "text")
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate(
        F.array_sort(F.transform(F.arrays_zip("lo", "hi"), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))),
        F.struct(zero.alias("n"), zero.alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["hi"] - F.greatest(s["lo"], a["to"]), zero)).alias("n"),
                              F.greatest(a["to"], s["hi"]).alias("to")), lambda a: a["n"])
    return hits(docs, benchmark, window).select(
        "rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without any test passage, with their columns."""
    found = contamination(docs, benchmark, window, id_column, text_column)
    flagged = shared.cut(found.where("contaminated").select(F.col("rid").alias("key")).distinct())
    return docs.select(shared.row_key(id_column, text_column).alias("key"), shared.whole_row(docs)) \
        .join(flagged, "key", "left_anti").select("row.*")
