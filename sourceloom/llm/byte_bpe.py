"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join with the token bytes.

A pattern splits every text into pre-tokens ("words"), which merge independently of each other. Texts are taken in
batches of some megabytes. A batch keeps its documents as rows of word numbers, which are the positions of the words,
and asks for each of its distinct words once. Requests are dealt and sorted by word over all batches, so every distinct
word meets one task, which encodes it once and answers all requests for it in turn. The answers are joined back to
their batches, where the documents are put together again from their word numbers. Decoding joins every id with its
row of the table of token bytes, whose size is that of the vocabulary, and puts the bytes together in order.

A frequent word is asked for at most once by a batch, so no word makes a hot key, and the rows of a batch are bounded
by ``BATCH_CHARS`` plus one document. Texts are never cut: a long one is split lazily and is a batch of its own size.

A null text counts as empty, and an empty text has no ids and no bytes. Documents are told apart by place, so repeated
rows and repeated or null ids each give a row. Only the key and the text are read; other columns may have any name. An
empty table gives no rows. The vocabulary must hold all single bytes, so that every text can be encoded.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm import shared

BATCH_CHARS = 32 << 20
ANSWER_IDS = 4 << 20           # ids a task holds before it hands them on
REQUESTS = 10_000              # words sent to Spark at once
PIECE = 1 << 19                # numbers packed or unpacked at once
DECODED = 256                  # rows decoded at once
LAZY_CHARS = 1 << 20           # longer texts are split piece by piece

# White space of the pattern dialect that the rank files are meant for (Unicode's White_Space).
SPACE_RANGES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
SPACES = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SPACE_RANGES)


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with the white space of the reference dialect; Python's counts four control characters too."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        if part == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
        elif part == r"\S":
            if inside:
                raise ValueError("\\S inside a character class")
            out.append(f"[^{SPACES}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return regex.compile("".join(out))


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def split(docs: DataFrame, pattern: str, key: str, text: str) -> DataFrame:
    """Two rows for every batch. Part ``docs``: keys and lengths (words) of its documents, and the numbers of all their
    words. Part ``words``: its distinct words, the most frequent first, whose places are the numbers, and their sizes.
    """
    schema = T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("numbers", T.BinaryType()),
        T.StructField("words", T.BinaryType()), T.StructField("part", T.StringType())])
    arrow = _arrow(schema)

    def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        words_of = splitter(pattern)
        made = 0
        keys, lengths, numbers, places, chars = [], [], array("I"), {}, 0

        def out() -> pa.RecordBatch:
            nonlocal made, keys, lengths, numbers, places, chars
            batch = (TaskContext.get().partitionId() << 32) + made
            seen = np.frombuffer(numbers, np.uint32)
            order = np.argsort(-np.bincount(seen, minlength=len(places)), kind="stable")
            rank = np.empty(len(places), np.uint32)
            rank[order] = np.arange(len(places), dtype=np.uint32)
            words = [w.encode() for w in places]
            words = [words[i] for i in order]
            rows = [{"batch": batch, "part": "docs", "keys": keys, "lengths": lengths, "numbers": _packed(rank[seen])},
                    {"batch": batch, "part": "words", "numbers": _packed(np.array([len(w) for w in words], np.uint32)),
                     "words": zstandard.ZstdCompressor(level=3).compress(b"".join(words))}]
            made += 1
            keys, lengths, numbers, places, chars = [], [], array("I"), {}, 0
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py() or ""
                found = words_of.findall(value) if len(value) < LAZY_CHARS else (m.group() for m in words_of.finditer(value))
                before = len(numbers)
                numbers.extend(places.setdefault(w, len(places)) for w in found)
                keys.append(name)
                lengths.append(len(numbers) - before)
                chars += len(value)
                if chars >= BATCH_CHARS:
                    yield out()
        if keys:
            yield out()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(split_batches, schema)


def requests(words: DataFrame) -> DataFrame:
    """(batch, place, word) of the rows of part ``words``."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for rows in batches:
            for batch, sizes, joined in zip(*(rows.column(c).to_pylist() for c in ("batch", "numbers", "words"))):
                ends = np.cumsum(_unpacked(sizes), dtype=np.int64)
                joined = zstandard.ZstdDecompressor().decompress(joined)
                for at in range(0, len(ends), REQUESTS):
                    stops = np.r_[ends[at - 1] if at else 0, ends[at:at + REQUESTS]]
                    part = joined[stops[0]:stops[-1]]
                    offsets = pa.py_buffer((stops - stops[0]).astype(np.int32).tobytes())
                    word = pa.StringArray.from_buffers(len(stops) - 1, offsets, pa.py_buffer(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(word), batch)), pa.array(np.arange(at, at + len(word), dtype=np.int32)), word],
                        names=["batch", "place", "word"])

    return words.select("batch", "numbers", "words").mapInArrow(unpack, "batch long, place int, word string")


def _packed(numbers) -> bytes:
    """Compressed numbers below 2**28, seven bits to a byte, lowest first; the high bit says that more follow."""
    import zstandard

    numbers = np.asarray(numbers, np.uint32)
    if numbers.max(initial=0) >= 1 << 28:
        raise ValueError("a number of 2**28 or more")
    pieces = []
    for at in range(0, len(numbers), PIECE):
        part = numbers[at:at + PIECE]
        digits = np.empty((len(part), 4), np.uint8)
        used = np.ones((len(part), 4), bool)
        for k in range(4):
            digits[:, k] = (part >> np.uint32(7 * k)) & np.uint32(127)
            used[:, k] = part >= 1 << 7 * k if k else True
        digits[:, :3] |= used[:, 1:].view(np.uint8) << 7
        pieces.append(digits[used].tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(pieces))


def _unpacked(packed: bytes) -> np.ndarray:
    import zstandard

    digits = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    out = [np.zeros(0, np.uint32)]
    at = 0
    while at < len(digits):
        part = digits[at:at + PIECE]
        last = np.flatnonzero(part < 128).astype(np.int32)       # a number has at most four digits
        first = np.r_[np.int32(0), last[:-1] + 1]
        found = np.zeros(len(last), np.uint32)
        for k in range(4):
            more = np.flatnonzero(first + k <= last)
            found[more] |= (part[first[more] + k] & np.uint8(127)).astype(np.uint32) << np.uint32(7 * k)
        out.append(found)
        at += int(last[-1]) + 1
    return np.concatenate(out)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode_words(asked: DataFrame, path: str, pattern: str) -> DataFrame:
    """Answers to requests (batch, place, word): rows (batch, places, sizes, ids) of packed numbers, one or a few for
    each task and batch. Requests for a word stand together in one task, which encodes it once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoder(path, pattern).encode_ordinary
        answers, held = {}, 0
        last = ids = None

        def out() -> pa.RecordBatch:
            rows = [(batch, *map(_packed, parts)) for batch, parts in answers.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.binary()] * 3])], names=ANSWER)

        for rows in batches:
            for batch, place, word in zip(*(c.to_pylist() for c in rows.columns)):
                if word != last:
                    last, ids = word, merge(word)
                places, sizes, flat = answers.setdefault(batch, (array("I"), array("I"), array("I")))
                places.append(place)
                sizes.append(len(ids))
                flat.extend(ids)
                held += len(ids)
                if held >= ANSWER_IDS:
                    yield out()
                    answers, held = {}, 0
        if answers:
            yield out()

    together = asked.select("batch", "place", "word").repartition("word").sortWithinPartitions("word")
    return together.mapInArrow(encode, "batch long, places binary, sizes binary, ids binary")


ANSWER = ["batch", "places", "sizes", "ids"]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """(key, ids) of every row; ids as packed little-endian unsigned 32-bit numbers (see ``id_lists``).

    With ``decoded``, the ids of each row are decoded where they are put together, as by ``decode``.
    """
    spark = docs.sparkSession
    batches = split(docs, pattern, key, text)
    folder = shared.written_parts(batches, "part")
    parts = {p: spark.read.schema(batches.drop("part").schema).parquet(f"{folder}/part={p}") for p in ("docs", "words")} \
        if shared.exists(spark, f"{folder}/part=docs") else {p: batches.limit(0) for p in ("docs", "words")}
    answers = shared.written(encode_words(requests(parts["words"]), path, pattern))
    shared.removed(spark, f"{folder}/part=words")               # all words are answered
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType())]
    schema = T.StructType([*fields, *([T.StructField("decoded", T.BinaryType())] if decoded else [])])
    texts = parts["docs"].select("batch", "keys", "lengths", "numbers")
    answers = answers.withColumnRenamed("batch", "asker")
    assemble = _assembler(_arrow(schema), token_table(docs, path) if decoded else None)
    return texts.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(assemble, schema)


def _assembler(schema: pa.Schema, table):
    def assemble(batch: pa.Table, answers: pa.Table) -> pa.Table:
        keys = batch.column("keys").combine_chunks().flatten()
        ends = np.cumsum(batch.column("lengths").combine_chunks().flatten().to_numpy())
        numbers = _unpacked(batch.column("numbers")[0].as_py())
        places, sizes, ids = ([_unpacked(v) for v in answers.column(c).to_pylist()] or [np.zeros(0, "<u4")]
                              for c in ("places", "sizes", "ids"))
        places, sizes, ids = map(np.concatenate, (places, sizes, ids))
        at = np.argsort(places)                                  # of each word, its place among the answers
        ends_of = np.cumsum(sizes, dtype=np.int64)
        begins, sizes = (ends_of - sizes)[at], sizes[at].astype(np.int64)
        rows = pa.array((_gather(ids, begins, sizes, numbers[first:last]).tobytes()
                         for first, last in zip(np.r_[0, ends[:-1]], ends)), pa.binary())
        if table is None:
            return pa.Table.from_arrays([keys, rows], schema=schema)
        return pa.Table.from_arrays([keys, rows, _decoded(rows, table)], schema=schema)

    return assemble


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that ``chosen`` names, one after the other."""
    if not len(chosen):
        return flat[:0]
    size = sizes[chosen]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1]) + np.repeat(begins[chosen] - ends + size, size)]


def token_table(df: DataFrame, path: str):
    """The token-byte table as a broadcast of flat arrays: as many rows as the vocabulary has, whatever the data."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 2)        # the last row stands for unknown ids
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.frombuffer(b"".join(tokens), np.uint8)
    return df.sparkSession.sparkContext.broadcast((flat, np.cumsum(sizes) - sizes, sizes))


def _decoded(ids: pa.Array, table) -> pa.Array:
    """Every id joined with its row of the token-byte table, put together row by row."""
    flat, begins, sizes = table.value

    def one(value) -> bytes | None:
        if not value.is_valid:
            return None
        rows = np.minimum(np.frombuffer(value.as_buffer(), "<u4"), len(sizes) - 1)
        return _gather(flat, begins, sizes, rows).tobytes()

    return pa.array((one(v) for v in ids), pa.binary())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the packed ``ids`` of every row.

    Every id is joined with its row of the token-byte table, which is sent to the tasks. An id that the vocabulary lacks
    has no bytes; null ids decode to null.
    """
    table = token_table(encoded, path)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, DECODED) for at in range(0, whole.num_rows, DECODED)):
                yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch.column("ids"), table)],
                                                 names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row: the ids of its text and the bytes that these ids decode to."""
    return encode(docs, path, pattern, key, text, decoded=True)


def id_lists(encoded: DataFrame) -> DataFrame:
    """The result of ``round_trip`` with ``ids`` as array<long>."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            lists = pa.array([np.frombuffer(v, "<u4").astype(np.int64) for v in batch.column(at).to_pylist()],
                             pa.list_(pa.int64()))
            yield batch.set_column(at, "ids", lists)

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())) if f.name == "ids" else f for f in encoded.schema])
    return encoded.mapInArrow(unpack, schema)
