"""Exact and approximate top-k search of question tables over vector tables.

Every question searches one repository. Vectors are scored where they lie: each task packs its rows into tiles, one row
for at most ``VECTOR_BLOCK`` neighbours of a repository, and questions are packed likewise. Tiles meet the question
tiles of their repository in a join on ``repo_id``. While Spark's estimate of the questions stays below its broadcast
threshold, it sends them to the tasks and no vector is shuffled; beyond it the tiles shuffle by repository, and adaptive
execution splits a hot one. A pair of tiles is one matrix product and gives at most ``fetch_k`` rows per question, so
the pairs of a repository are never written as rows. A window then merges the winners of all tiles.

No job runs while a search is planned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.functions.vector import BUCKETS
from sourceloom.limits import DEFAULTS, Limits
from sourceloom.operators.ranking import top_per_key

VECTOR_BLOCK = 4_096     # vectors scored at once
QUESTION_BLOCK = 2_048   # questions scored at once
BUCKET_ROWS = 2          # rows of a repository that an approximate search expects in a bucket
MOST_BITS = 24


def fetch_k(top_k: Column | str, limits: Limits = DEFAULTS) -> Column:
    """How many hits to fetch so that ``top_k`` remain after overlapping ones are removed."""
    wanted = F.col(top_k) if isinstance(top_k, str) else top_k
    return F.least(wanted * 2, F.lit(limits.max_top_k))


def tiles(df: DataFrame, keys: list[str], size: int, order: list[str], suffix: str) -> DataFrame:
    """Rows packed where they lie: one row for at most ``size`` rows of a task with equal keys, sorted by ``order``,
    whose other columns become arrays named with ``suffix``. Rows with a null key are left out.
    """
    rest = [c for c in df.columns if c not in keys]

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in [*keys, *order]])
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            first = np.arange(table.num_rows) == 0
            for key in keys:
                codes = columns[key].dictionary_encode().indices.to_numpy()
                first[1:] |= codes[1:] != codes[:-1]
            runs = np.flatnonzero(first)
            ends = np.r_[runs[1:], table.num_rows]
            starts = np.concatenate([np.arange(a, b, size) for a, b in zip(runs, ends)])
            offsets = pa.array(np.r_[starts, table.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[columns[k].take(pa.array(starts)) for k in keys],
                 *[pa.ListArray.from_arrays(offsets, columns[c]) for c in rest]],
                names=[*keys, *[c + suffix for c in rest]])

    schema = T.StructType([*[df.schema[k] for k in keys],
                           *[T.StructField(c + suffix, T.ArrayType(df.schema[c].dataType)) for c in rest]])
    known = df.select(*keys, *rest).dropna(subset=keys)
    return known.mapInArrow(pack, schema)


def _tile_scorer(kind: str, dims: int, digits: int | None) -> Callable:
    """Scoring of pairs of tiles. Nested, so that it travels to executors by value."""

    def matrix(part):
        import numpy as np

        if kind == "sparse":
            buckets, counts = part("buckets"), part("tfs")
            out = np.zeros((len(buckets), dims))
            rows = np.repeat(np.arange(len(buckets)), np.diff(buckets.offsets.to_numpy()))
            out[rows, buckets.flatten().to_numpy()] = counts.flatten().to_numpy()
            return out, part("norm2").to_numpy().astype(float)
        vectors = part("vector")
        out = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
        return out, np.einsum("ij,ij->i", out, out)

    def winners(left, left_norm, right, right_norm, wanted):
        import numpy as np

        product = np.outer(right_norm, left_norm)
        dots = right @ left.T
        # Counts are integers, so sparse products are exact in any order of summation.
        scores = np.divide(dots, np.sqrt(product), out=np.full_like(dots, -np.inf), where=product > 0)
        if kind == "sparse":
            scores[dots <= 0] = -np.inf      # no shared bucket: no hit
        elif digits is not None:
            scores = np.round(scores, digits)
        rows, columns = [], []
        for q, k in enumerate(wanted):
            line = scores[q]
            if k < 1:
                continue
            bound = np.partition(line, line.size - k)[line.size - k] if k < line.size else -np.inf
            candidates = np.flatnonzero((line >= bound) & (line > -np.inf))
            # Vectors are in order of their ids, so equal scores rank by id.
            best = candidates[np.argsort(-line[candidates], kind="stable")[:k]]
            rows.append(np.full(best.size, q))
            columns.append(best)
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        rows, columns = np.concatenate(rows), np.concatenate(columns)
        return rows, columns, scores[rows, columns]

    def score(batches):
        import pyarrow as pa

        last = None                          # the tile of the row before: it often meets several question tiles
        for batch in batches:
            for i in range(batch.num_rows):
                vector = lambda name: batch.column(name + "_v")[i].values      # noqa: B023, E731
                question = lambda name: batch.column(name + "_q")[i].values    # noqa: B023, E731
                ids, names, wanted = vector("id"), question("question_id"), question("fetch_k")
                if last is None or not last[0].equals(ids):
                    last = (ids, *matrix(vector))
                rows, columns, scores = winners(*last[1:], *matrix(question), wanted.to_pylist())
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(rows)), wanted.take(pa.array(rows)),
                         batch.column("repo_id").take(pa.array([i] * len(rows))), ids.take(pa.array(columns)),
                         pa.array(scores)], names=["question_id", "fetch_k", "repo_id", "id", "score"])

    return score


def _search(vectors: DataFrame, questions: DataFrame, kind: str, columns: list[str], dims: int = 0,
            digits: int | None = None) -> DataFrame:
    """Top ``fetch_k`` ids of every tile for each question of its repository."""
    v = tiles(vectors.select("repo_id", "id", *columns), ["repo_id"], VECTOR_BLOCK, ["id"], "_v")
    q = tiles(questions.select("repo_id", "question_id", "fetch_k", *columns), ["repo_id"], QUESTION_BLOCK, [], "_q")
    fields = [questions.schema["question_id"], questions.schema["fetch_k"], vectors.schema["repo_id"], vectors.schema["id"],
              T.StructField("score", T.DoubleType())]
    return v.join(q, "repo_id").mapInArrow(_tile_scorer(kind, dims, digits), T.StructType(fields))


def _merge(found: DataFrame, limits: Limits = DEFAULTS) -> DataFrame:
    """Keep the best ``fetch_k`` of all blocks; ``fetch_k`` never exceeds ``max_top_k``."""
    order = [F.desc("score"), F.asc("id")]
    ranked = top_per_key(found, ["question_id"], order, limits.max_top_k, salt_by=["id"])
    return ranked.where(F.col("rank") <= F.col("fetch_k")).select(
        "question_id", "repo_id", "rank", "score", "id")


def search_sparse(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """Cosine top-k over hashed word counts.

    ``vectors``: id, repo_id, buckets, tfs, norm2. ``questions``: question_id, repo_id, fetch_k and
    the same vector columns.
    """
    found = _search(vectors, questions, "sparse", ["buckets", "tfs", "norm2"], BUCKETS)
    return _merge(found)


def search_dense(vectors: DataFrame, questions: DataFrame, digits: int = 4) -> DataFrame:
    """Cosine top-k over dense vectors (``vector``: array of floats).

    Scores are rounded to ``digits`` places before ranking, so that equal vectors tie in every
    order of summation and the id decides.
    """
    found = _search(vectors, questions, "dense", ["vector"], digits=digits)
    return _merge(found)


def with_buckets(df: DataFrame, dims: int, tables: int, bits: int) -> DataFrame:
    """Repeat every row for each hash table, with its bucket there (``lsh_table``, ``lsh_bucket``).

    A bucket number holds the signs of the products with ``bits`` hyperplanes.
    """
    planes = hyperplanes(dims, tables * bits)

    def hash_batches(batches):
        import numpy as np
        import pyarrow as pa

        normals = np.array(planes, dtype=float).T
        weights = 1 << np.arange(bits)
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            signs = flat.astype(float).reshape(batch.num_rows, dims) @ normals >= 0
            numbers = signs.reshape(batch.num_rows, tables, bits) @ weights
            buckets = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()),
                pa.array(numbers.ravel().astype("int32")))
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets],
                                             names=[*batch.schema.names, "_buckets"])

    schema = T.StructType([*df.schema, T.StructField("_buckets", T.ArrayType(T.IntegerType()))])
    hashed = df.mapInArrow(hash_batches, schema)
    return hashed.select(*df.columns, F.posexplode("_buckets").alias("lsh_table", "lsh_bucket"))


def hyperplanes(dims: int, count: int) -> list[list[int]]:
    """Reproducible +-1 hyperplanes."""
    from hashlib import md5

    def sign(plane: int, dim: int) -> int:
        last_digit = md5(f"{plane}:{dim}".encode()).hexdigest()[-1]
        return 1 if int(last_digit, 16) % 2 else -1

    return [[sign(p, d) for d in range(dims)] for p in range(count)]


def lsh_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Bits of a bucket number for so many rows in a repository: about ``bucket_rows`` rows share a bucket."""
    return min(max(math.ceil(math.log2(max(rows, 1) / bucket_rows)), 1), MOST_BITS)


def lsh_index(vectors: DataFrame, dims: int, tables: int, bits: int) -> DataFrame:
    """(repo_id, lsh_table, lsh_bucket, id): ids by hash, without vectors."""
    return with_buckets(vectors.select("repo_id", "id", "vector"), dims, tables, bits).select(
        "repo_id", "lsh_table", "lsh_bucket", "id")


def lsh_probes(questions: DataFrame, dims: int, tables: int, bits: int, flips: int) -> DataFrame:
    """(question_id, repo_id, lsh_table, lsh_bucket) of the buckets that differ from a question's in at most ``flips`` bits."""
    masks = [sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(range(bits), n)]
    own = with_buckets(questions.select("question_id", "repo_id", "vector"), dims, tables, bits)
    mask = F.explode(F.array(*[F.lit(m) for m in masks]))
    return own.select("question_id", "repo_id", "lsh_table", "lsh_bucket", mask.alias("mask")).select(
        "question_id", "repo_id", "lsh_table", F.col("lsh_bucket").bitwiseXOR(F.col("mask")).alias("lsh_bucket"))


def lsh_candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(question_id, repo_id, id): what shares a probed bucket in any table, once. Only hashes and ids take part."""
    return index.join(probes, ["repo_id", "lsh_table", "lsh_bucket"]).select("question_id", "repo_id", "id").distinct()


def _pair_scores(pairs: DataFrame, digits: int) -> DataFrame:
    """Cosine of ``vector`` and ``asked`` of every row, rounded; rows with a zero vector are dropped."""

    def score(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                           for c in ("vector", "asked"))
            product = np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right)
            with np.errstate(invalid="ignore", divide="ignore"):
                found = np.round(np.einsum("ij,ij->i", left, right) / np.sqrt(product), digits)
            rest = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("question_id", "fetch_k", "repo_id", "id")], pa.array(found)],
                names=["question_id", "fetch_k", "repo_id", "id", "score"])
            yield rest.filter(pc.is_finite(rest.column("score")))

    kept = ["question_id", "fetch_k", "repo_id", "id"]
    return pairs.select(*kept, "vector", "asked").mapInArrow(
        score, T.StructType([*[pairs.schema[c] for c in kept], T.StructField("score", T.DoubleType())]))


def search_lsh(vectors: DataFrame, questions: DataFrame, dims: int, bits: int, tables: int = 8, flips: int = 1,
               digits: int = 4) -> DataFrame:
    """Approximate form of ``search_dense``: only vectors in a probed bucket are scored, each once per question.

    Buckets are matched by hash and id alone, so vectors are read once, for the scoring join. ``bits`` should come from
    the rows of a repository (``lsh_bits``); more ``tables`` or ``flips`` find more.
    """
    pairs = lsh_candidates(lsh_index(vectors, dims, tables, bits), lsh_probes(questions, dims, tables, bits, flips))
    asked = questions.select("question_id", "repo_id", "fetch_k", F.col("vector").alias("asked"))
    rows = pairs.join(asked, ["question_id", "repo_id"]).join(vectors.select("repo_id", "id", "vector"), ["repo_id", "id"])
    return _merge(_pair_scores(rows, digits))
