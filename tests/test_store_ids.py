"""Ids that look like numbers or dates survive a merge, and rows a merge that stops."""

import shutil

import pytest
from pyspark.sql import functions as F

from sourceloom.sources import store

COLUMNS = "id string, repo_id string, seq long, content string"


def test_ids_stay_text(spark, tmp_path):
    ids = ["007", "012", "1e5", "2024-01-01", "1.0", "null"]
    path = f"{tmp_path}/store"
    store.upsert_store(spark, spark.createDataFrame([(f"{r}:1", r, 1, "a") for r in ids], COLUMNS), path)
    store.upsert_store(spark, spark.createDataFrame([("007:2", "007", 2, "b")], COLUMNS), path)
    rows = sorted((r.repo_id, r.id) for r in store.read_store(spark, path).collect())
    assert rows == sorted([(r, f"{r}:1") for r in ids] + [("007", "007:2")])


def test_a_stopped_merge_loses_no_rows(spark, tmp_path, monkeypatch):
    """The merge stops when its rows are written and the old ones are gone."""
    def rows(*found):
        return spark.createDataFrame(found, "id string, repo_id string, text string, seq long")

    def held():
        return sorted((r.id, r.repo_id, r.text) for r in store.read_store(spark, path).collect())

    path = str(tmp_path / "store")
    store.upsert_store(spark, rows(("a", "007", "old", 1), ("b", "1e5", "b", 1)), path)
    with monkeypatch.context() as stopped:
        finish, calls = store.finish_merge, []

        def stop(spark, at):
            calls.append(at)
            if len(calls) > 1:
                shutil.rmtree(tmp_path / "store" / "chunks" / "repo_id=007")
                raise RuntimeError("stopped")
            finish(spark, at)

        stopped.setattr(store, "finish_merge", stop)
        with pytest.raises(RuntimeError):
            store.upsert_store(spark, rows(("a", "007", "new", 2), ("c", "007", "c", 2)), path)
    after = [("a", "007", "new"), ("b", "1e5", "b"), ("c", "007", "c")]
    assert held() == after
    store.upsert_store(spark, rows(("d", "x", "d", 3)), path)
    assert held() == [*after, ("d", "x", "d")] and not (tmp_path / "store" / "pending").exists()


def test_a_merge_that_did_not_write_all_its_rows_does_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    new = spark.createDataFrame([("a", "r", "x", 1)], "id string, repo_id string, text string, seq long")
    store.upsert_store(spark, new, path)
    new.withColumn("text", F.lit("half")).write.partitionBy("repo_id").parquet(f"{path}/pending")
    (tmp_path / "store" / "pending" / "_SUCCESS").unlink()
    assert [r.text for r in store.read_store(spark, path).collect()] == ["x"]
    store.upsert_store(spark, new.withColumn("id", F.lit("b")), path)
    assert sorted((r.id, r.text) for r in store.read_store(spark, path).collect()) == [("a", "x"), ("b", "x")]
