"""Feature hashing and cosine similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.text import as_column, let, words

BUCKETS = 1024  # fixed value: vector dimensions
EMPTY_FEATURES = "struct(cast(array() as array<int>) as buckets, cast(array() as array<int>) as tfs)"


def bucket(word: Column) -> Column:
    """Bucket of a word: the low bits of the first 32 bits of its MD5 (digits 6-8 suffice)."""
    digits = F.substring(F.md5(word), 6, 3)
    return F.conv(digits, 16, 10).cast("int") % F.lit(BUCKETS)


def features(text: Column | str) -> Column:
    """``struct(buckets, tfs)``: distinct buckets in ascending order and their counts.

    Counts come from run lengths of the sorted bucket array, so the work stays inside the row and
    no shuffle of words is needed.
    """
    hashed = F.sort_array(F.transform(words(text), bucket))

    def encode(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda b, i: F.when((i == 0) | (b != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(starts, lambda st: F.struct(
            F.transform(st, lambda p: F.get(s, p)).alias("buckets"),
            F.transform(st, lambda p, i: F.coalesce(F.get(st, i + 1), F.size(s)) - p).alias("tfs"),
        ))

    return F.coalesce(let(hashed, encode), F.expr(EMPTY_FEATURES))


def folded(text: Column | str, dims: int = 64) -> Column:
    """Dense word counts: buckets folded into ``dims`` places, each added or subtracted by its own sign."""
    def fold(f: Column) -> Column:
        pairs = F.arrays_zip(f["buckets"].alias("b"), f["tfs"].alias("n"))
        signed = F.transform(pairs, lambda p: F.struct(
            (p["b"] % dims).alias("d"), F.when(F.floor(p["b"] / dims) % 2 == 1, p["n"]).otherwise(-p["n"]).alias("n")))
        return let(signed, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(
            F.filter(ps, lambda p: p["d"] == d), F.lit(0), lambda a, p: a + p["n"]).cast("float")))

    return let(features(text), fold)


def squared_norm(counts: Column | str) -> Column:
    """Exact integer squared norm of an array of counts."""
    return F.aggregate(
        as_column(counts), F.lit(0).cast("bigint"),
        lambda acc, n: acc + n.cast("bigint") * n.cast("bigint"),
    )


def sparse_dot(left: Column | str, right: Column | str) -> Column:
    """Exact dot product of two feature structs."""
    lookup = F.map_from_arrays(as_column(right)["buckets"], as_column(right)["tfs"])
    terms = F.arrays_zip(as_column(left)["buckets"].alias("b"), as_column(left)["tfs"].alias("n"))
    return let(lookup, lambda m: F.aggregate(
        terms, F.lit(0).cast("bigint"),
        lambda acc, t: acc + t["n"].cast("bigint")
        * F.coalesce(F.try_element_at(m, t["b"]), F.lit(0)).cast("bigint"),
    ))


def sparse_cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine of two feature structs; 0 where either side is empty."""
    product = squared_norm(as_column(left)["tfs"]) * squared_norm(as_column(right)["tfs"])
    return F.when(product > 0, sparse_dot(left, right) / F.sqrt(product)).otherwise(F.lit(0.0))
