"""Text classification with subword-bag embeddings and a linear softmax, trained jointly in numpy.

A text is cut into segments of ``segment`` words, not counting words that repeat the one before (0: one segment). The features of a segment are its words and
the 3- to 5-character n-grams of its words with their edges, hashed into a table of vectors; marker
features can be added for a word that repeats the one before, and for a word pair that the text had before. A
segment is the mean of its feature vectors, and a softmax over it gives the label; vectors and softmax are
learned together by stochastic gradient descent. As words share n-gram vectors, unseen spellings get the
vectors of their parts. The logit of a text is that of its most striking segment; a logistic curve fitted
to the training texts turns it into a score.

The model is fitted on the driver on at most ``SAMPLE_PER_LABEL`` labelled texts of each label, chosen by hash of
the id. Scoring visits every text as a whole. The model is linear in its vectors, so a task gets one number per
table slot and adds up numbers.

Null and empty texts have no features and get the score of logit zero features (the prior). Rows without a label or
id are not learned from; several labels of one id count as their largest. Without two labels, every score is the
share of label 1. Repeated rows get equal scores. An empty table gives no rows. Only id and text are read, so
further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm import arrays

SAMPLE_PER_LABEL = 1200
TRAIN_CHUNK = 1 << 19        # characters of text whose features are built at once
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    segment: int = 0               # words per segment; 0: the whole text
    fold_case: bool = True
    separators: str = " \t\n\x0b\f\r"
    markers: bool = False          # features for repeated words and word pairs
    bits: int = 18                 # of the hash table
    width: int = 10                # of a vector
    epochs: int = 8
    rate: float = 0.1
    longest: int = 5               # characters of an n-gram
    batch: int = 64
    seed: int = 7


class Features:
    """Slots and segments of a list of texts, flat: feature i has ``slot[i]`` and lies in ``segment[i]``."""

    def __init__(self, texts: list[str], s: Settings):
        joined = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if s.fold_case:                            # ASCII and Latin-1 capitals
            capital = ((code >= 65) & (code <= 90)) | ((code >= 0xC0) & (code <= 0xDE) & (code != 0xD7))
            code = np.where(capital, code + np.uint32(32), code)
        gap = np.isin(code, np.array([ord(c) for c in s.separators], np.uint32))
        code = np.where(gap, np.uint32(32), code)
        row_start = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1] + 1
        first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
        last = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        row_words = np.searchsorted(first, row_start)
        word_row = np.searchsorted(row_start, first, side="right") - 1
        hashes = arrays.Prefix(code.astype(_U) + _U(1)).spans(first, last)
        same_row = word_row[1:] == word_row[:-1]
        repeat = np.zeros(len(first), bool)
        repeat[1:] = (hashes[1:] == hashes[:-1]) & same_row
        # Segments are filled with words that differ from the one before; a short rest joins the last segment.
        new = np.cumsum(~repeat)
        index = new - new[row_words[word_row]] if len(first) else new
        per_row = np.bincount(word_row, ~repeat, len(texts)).astype(np.int64)
        count = np.maximum(per_row // s.segment, 1) if s.segment else np.ones(len(texts), np.int64)
        self.row_segments = np.concatenate([[0], np.cumsum(count)])
        self.rows = np.repeat(np.arange(len(texts)), count)
        word_segment = self.row_segments[word_row]
        if s.segment:
            word_segment = np.where(repeat, -1, word_segment + np.minimum(index // s.segment, count[word_row] - 1))
        shift = np.uint32(32 - s.bits)
        slots, segments = [], []
        if len(first):
            slots.append((hashes >> _U(64 - s.bits)).astype(np.int64))
            segments.append(word_segment)
            # The word a position belongs to; the gap before a word belongs to it.
            owner = np.zeros(len(code), np.int64)
            owner[last[:-1]] = 1
            owner = np.minimum(np.cumsum(owner), len(first) - 1)
            place = word_segment[owner]
            h = code
            inner = np.zeros(len(code), bool)
            for n in range(2, s.longest + 1):
                h = h[:-1] * np.uint32(0x01000193) + code[n - 1:]
                inner = inner[:-1] | (gap[n - 2:-1] if n > 2 else False)
                if n < 3:
                    continue
                # A gap may open or close an n-gram; an n-gram that opens with one belongs to the word after it.
                at = np.flatnonzero(~inner)
                slots.append((((h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)) >> shift).astype(np.int64))
                segments.append(place[at + 1])
            if s.markers:
                pair = arrays.mix(hashes[1:] ^ arrays.mix(hashes[:-1]))
                twice = np.flatnonzero(repeat)
                key = arrays.mix(pair ^ arrays.mix(word_row[1:].astype(_U)))
                again = np.ones(len(key), bool)
                again[np.unique(key, return_index=True)[1]] = False
                again = np.flatnonzero(again & same_row) + 1
                for slot, words in ((0, twice), (1, again)):
                    for copy in range(4):              # as heavy as the n-grams of a word
                        slots.append(np.full(len(words), slot * 4 + copy))
                        segments.append(word_segment[words])
        self.slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        self.segment = np.concatenate(segments) if segments else np.zeros(0, np.int64)
        used = self.segment >= 0
        self.slot, self.segment = self.slot[used], self.segment[used]

    @property
    def size(self) -> np.ndarray:
        return np.bincount(self.segment, minlength=len(self.rows))


@dataclass
class Model:
    settings: Settings
    slots: np.ndarray = field(repr=False)          # logit of label 1 against 0 of each slot
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        f = Features(texts, self.settings)
        total = np.bincount(f.segment, self.slots[f.slot], len(f.rows))
        value = total / np.maximum(f.size, 1) + self.bias
        return np.maximum.reduceat(value, f.row_segments[:-1]) if len(texts) else value

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -30, 30)))


def _bags(texts: list[str], y: np.ndarray, s: Settings):
    """Slots and their shares of each segment (every distinct slot once), segment bounds, segment labels."""
    slots, shares, sizes, targets, first = [], [], [], [], 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last]) <= TRAIN_CHUNK):
            chars += len(texts[last])
            last += 1
        f = Features(texts[first:last], s)
        key, times = np.unique(f.segment << s.bits | f.slot, return_counts=True)
        owner = key >> s.bits
        slots.append((key & ((1 << s.bits) - 1)).astype(np.int32))
        shares.append((times / f.size[owner]).astype(np.float32))
        sizes.append(np.bincount(owner, minlength=len(f.rows)))
        targets.append(y[first + f.rows].astype(int))
        first = last
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(slots), np.concatenate(shares), bounds, np.concatenate(targets)


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(s, np.zeros(1 << s.bits, np.float32), scale=0.0, shift=float(np.log(share / (1 - share))))
    slot, share, bounds, target = _bags(texts, y, s)
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (1 << s.bits, s.width)).astype(np.float32)
    softmax = rng.uniform(-1, 1, (2, s.width)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # Adaptive rates: a slot seen rarely moves as far as a frequent one.
    past = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, softmax, bias)]
    usable = np.flatnonzero(np.diff(bounds))
    steps, step = s.epochs * -(-len(usable) // s.batch), 0
    for _ in range(s.epochs):
        for chosen in np.array_split(rng.permutation(usable), -(-len(usable) // s.batch)):
            rate = s.rate * (1 - step / steps)
            step += 1
            n = bounds[chosen + 1] - bounds[chosen]
            at = arrays.ranges(bounds[chosen], n)
            where, inverse = np.unique(slot[at], return_inverse=True)
            row = np.repeat(np.arange(len(chosen)), n)
            bag = np.zeros((len(chosen), len(where)), np.float32)
            bag[row, inverse] = share[at]
            hidden = bag @ vectors[where]
            z = hidden @ softmax.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), target[chosen]] -= 1
            p /= len(chosen)
            steps_ = [(vectors, past[0], bag.T @ (p @ softmax), where), (softmax, past[1], p.T @ hidden, slice(None)),
                      (bias, past[2], p.sum(0), slice(None))]
            for value, seen, gradient, rows in steps_:
                seen[rows] += gradient * gradient
                value[rows] -= rate * gradient / np.sqrt(seen[rows])
    model = Model(s, vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]))
    return _calibrated(model, texts, y)


def _calibrated(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """Logistic curve from text logits to labels, by Newton steps with a weak prior."""
    x = np.concatenate([model.logits(texts[i:i + 50]) for i in range(0, len(texts), 50)])
    middle, spread = float(x.mean()), float(x.std()) or 1.0
    x = (x - middle) / spread
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.01 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    model.scale, model.shift = float(w[0] / spread), float(w[1] - w[0] * middle / spread)
    return model


def in_fold(id_column: str, modulus: int, remainder: int):
    """True for rows whose crc32 of the id as text has this remainder (a null id counts as '')."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)) == remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, per_label: int = SAMPLE_PER_LABEL):
    """Texts and labels of at most ``per_label`` ids of each label outside the held-out fold, chosen by hash;
    of an id with several texts the greatest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out) \
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * per_label ids, and one text of each, whatever the size of the tables.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y") \
        .agg(F.max("text").alias("text")).orderBy("doc_id").collect()
    share = known.agg(F.avg("y").alias("share")).first()["share"]
    return [r["text"] or "" for r in rows], [r["y"] for r in rows], share


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in arrays.slices(batch):
                texts = [t or "" for t in batch.column(1)[rows.start:rows.stop].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start:rows.stop], pa.array(model.scores(texts))], ["doc_id", "score"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")) \
        .mapInArrow(scan, f"doc_id {id_type}, score double")
