import pytest

from sourceloom.limits import BOUNDED
from sourceloom.operators import files
from sourceloom.sources import walk
from sourceloom.sources.tree import scan_tree

TREE = {
    "one/__init__.py": "x = 1", "one/_private/deep/er/_a.py": "y = 2", "one/.env.py": "z", "one/src dir/a+b%20.py": "ü",
    "one/node_modules/lib/index.js": "n", "one/.git/hooks/h.py": "g", "one/empty.py": "", "one/notes.adoc": "t",
    "build/main.go": "package main", "build/build/out.go": "o", "two/big.py": "x" * 102_401, "beside.py": "no repository",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "one" / "loop").symlink_to(tmp_path / "one")
    return tmp_path


def found(df):
    return sorted((r.repo_id, r.path, r.size, r.content) for r in df.collect())


def test_every_name_is_found(spark, tree):
    got = found(walk.walk_tree(spark, str(tree)))
    kept = ["build/main.go", "one/.env.py", "one/__init__.py", "one/_private/deep/er/_a.py", "one/src dir/a+b%20.py", "two/big.py"]
    assert got == sorted((*k.split("/", 1), len(TREE[k].encode()), TREE[k]) for k in kept)
    assert {r[1] for r in found(walk.walk_tree(spark, str(tree), limits=BOUNDED))} == {r[1] for r in got} - {"big.py"}
    (tree / "one" / "loop").unlink()              # Spark's listing follows links
    assert set(found(scan_tree(spark, str(tree)))) <= set(got)


def test_one_repository(spark, tree):
    whole = [r[1:] for r in found(walk.walk_tree(spark, str(tree))) if r[0] == "one"]
    for address in (str(tree / "one"), f"file://{tree}/one"):
        assert found(walk.walk_tree(spark, address, repo_id="r")) == [("r", *r) for r in whole]


def test_skipped_folders_are_not_entered(spark, tree):
    listed = {f"{r.repo_id}/{r.path}" for r in walk.list_tree(spark, str(tree)).collect()}
    assert listed == {k for k in TREE if not {"node_modules", ".git"} & set(k.split("/"))} - {"build/build/out.go", "beside.py"}
    every = {f"{r.repo_id}/{r.path}" for r in walk.list_tree(spark, str(tree), every_file=True).collect()}
    assert every == set(TREE) - {"beside.py"}


def test_outcomes_of_empty_and_unreadable_files(spark, tree, monkeypatch):
    every = walk.walk_tree(spark, str(tree), every_file=True)
    got = {f"{r.repo_id}/{r.path}": r.outcome for r in files.file_outcomes(every, BOUNDED).collect()}
    assert set(got) == set(TREE) - {"beside.py"}
    assert (got["one/empty.py"], got["one/.git/hooks/h.py"], got["two/big.py"], got["one/__init__.py"]) == (
        "empty", "skipped_dir", "too_large", "eligible")
    # Listed, then gone before it is read.
    gone = spark.createDataFrame([("one", "__init__.py", 5), ("one", "gone.py", 9)], "repo_id string, path string, size long")
    monkeypatch.setattr(walk, "_listed", lambda *a: gone)
    left = files.file_outcomes(walk.walk_tree(spark, str(tree)), BOUNDED)
    assert {r.path: r.outcome for r in left.collect()} == {"__init__.py": "eligible", "gone.py": "unreadable"}


def test_no_repositories(spark, tmp_path):
    assert walk.walk_tree(spark, str(tmp_path)).count() == 0


def test_batches_end_where_they_are_full(spark, tree, monkeypatch):
    monkeypatch.setattr(walk, "READ_BYTES", 1)
    monkeypatch.setattr(walk, "LISTED", 1)
    assert walk.walk_tree(spark, str(tree)).count() == 6
