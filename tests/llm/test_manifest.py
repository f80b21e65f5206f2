"""The recursive manifest against a plain version, over group sizes around powers of the fan."""

import pytest

from sourceloom.llm import manifest
from tests.llm import brute

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, rid string, number long, m int, up string"


def check(df):
    rows = [tuple(r) for r in df.select(*FIELDS).collect()]
    got = sorted((tuple(r) for r in manifest.audit_documents(df).select(*COLUMNS).collect()), key=str)
    assert got == sorted(brute.manifest(rows), key=str)
    return got


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_odd_tables(request, table):
    check(request.getfixturevalue(table))


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [81], [82], [1, 1], [1, 3, 9, 27], [244, 2, 80, 10]])
def test_group_sizes(spark, sizes):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            n += 7
            rows.append((n, None if s == 1 else f"s{s}", "en", n, f"a\nb {n}" if n % 3 else "plain", "x", "x", 1, 1, "x"))
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {g[6] for g in got} == ({True, False} if sum(sizes) > 20 else {g[6] for g in got})


def test_many_groups_names_by_bytes_and_null_fields(spark):
    names = [None, "", "é", "z", "Z", "a", "aa", "ￜ", "😀"] + [f"g{i}" for i in range(20)]
    rows = [(i, name, None, None, None if i % 2 else "\n", None, None, None, None, None) for i, name in enumerate(names)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_one_row_repeated_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(manifest, "STOREY", 1)
    rows = [(5, "s", "en", 3, "a\nb", None, None, None, None, None)] * 300
    rows += [(None, None, None, None, "x\n" * 500_000, None, None, None, None, None)] * 3
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert len(got) == 303


def test_recursion_limit_is_restored(spark, docs):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest.audit_documents(docs)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
