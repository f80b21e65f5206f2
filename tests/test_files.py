import pytest
from pyspark.sql import functions as F

from sourceloom.functions import rules, text
from sourceloom.limits import BOUNDED
from sourceloom.operators import files
from sourceloom.operators.ranking import top_per_key
from sourceloom.sources.tree import scan_tree

FILES = "repo_id string, path string, size long, content string"


def paths(df):
    return [r.path for r in df.collect()]


def make(spark, names, content="x = 1", size=5):
    return spark.createDataFrame([("r", n, size, content) for n in names], FILES)


@pytest.mark.parametrize("path,expected", [
    ("tools/build_docs.py", "python"), ("web/cart.TS", "typescript"), ("web/Cart.tsx", "tsx"), ("cfg/webpack.js", "javascript"),
    ("ui/list.jsx", "javascript"), ("cmd/serve.go", "go"), ("core/heap.rs", "rust"), ("org/Ledger.java", "java"),
    ("a/b.CPP", "cpp"), ("drivers/uart.c", "c"), ("a.tar.rb", "ruby"), ("notes.adoc", None), ("theme.scss", None),
    (".py", None), ("a.py/readme", None), ("LICENCE", None),
])
def test_language_by_suffix(spark, path, expected):
    row = spark.createDataFrame([(path,)], "p string").select(rules.detect_language("p").alias("l")).first()
    assert row.l == expected


def test_skipped_directories(spark):
    df = make(spark, ["src/a.py", "node_modules/a.py", "a/.git/b.py", "a/.x/b.py", ".env.py",
                      "builds/a.py", "build/a.py", "a/target/b.py", "venv/x/a.py", "dist.py"])
    kept = df.where(~files.in_skipped_dir("path"))
    assert paths(kept) == ["src/a.py", ".env.py", "builds/a.py", "dist.py"]


def test_skipped_names(spark):
    df = make(spark, ["a.min.js", "b.js", "Cargo.lock", "x/yarn.lock", "c.map", "d.min.css", "go.sum.py"])
    assert paths(df.where(~files.is_skipped_name("path"))) == ["b.js", "go.sum.py"]
    exact = df.where(~files.is_skipped_name("path", glob_skip=False))
    assert paths(exact) == ["a.min.js", "b.js", "c.map", "d.min.css", "go.sum.py"]


def test_size_and_blank_content(spark):
    rows = [("r", "zero.py", 0, "x"), ("r", "one.py", 1, "x"), ("r", "max.py", 102_400, "x"),
            ("r", "over.py", 102_401, "x"), ("r", "blank.py", 4, " \n\t\r\x0b\f"), ("r", "doc.txt", 3, "x")]
    df = spark.createDataFrame(rows, FILES)
    assert sorted(paths(files.eligible_files(df))) == ["max.py", "one.py", "over.py"]
    assert sorted(paths(files.eligible_files(df, BOUNDED))) == ["max.py", "one.py"]
    assert sorted(paths(files.eligible_files(df, max_bytes=1))) == ["one.py"]


def test_no_cap_by_default(spark):
    rows = [("r", f"d{i % 9}/f{i}.py", 5, "x = 1") for i in range(2000)] + [("r", "big.py", 300_000, "x " * 150_000)]
    assert files.eligible_files(spark.createDataFrame(rows, FILES)).count() == 2001


def test_cap_counts_eligible_files_in_path_part_order(spark):
    # As strings "a-b/x.py" < "a/x.py"; as parts it is the other way round.
    df = make(spark, ["a-b/x.py", "a/x.py", "a/node_modules/y.py", "0.txt", "b.py"])
    assert sorted(paths(files.eligible_files(df, max_files=2))) == ["a-b/x.py", "a/x.py"]
    assert paths(files.eligible_files(df, max_files=1)) == ["a/x.py"]
    assert len(paths(files.eligible_files(df, max_files=0))) == 3      # 0 means the default


def test_cap_of_a_hot_repository_equals_plain_ranking(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("r"), (F.col("id") % 50).cast("string")))
        .otherwise("hot").alias("repo_id"),
        F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string"),
                 F.lit(".py")).alias("path"), F.lit(5).cast("long").alias("size"), F.lit("x").alias("content"))
    got = {(r.repo_id, r.path) for r in files.eligible_files(df, max_files=11).collect()}
    by_repo = {}
    for r in df.collect():
        by_repo.setdefault(r.repo_id, []).append(r.path)
    want = {(k, p) for k, v in by_repo.items() for p in sorted(v, key=lambda p: p.split("/"))[:11]}
    assert got == want


def test_top_per_key_does_not_depend_on_salts(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    plain = top_per_key(df, ["k"], order, 9).collect()
    for salts in (2, 64):
        salted = top_per_key(df, ["k"], order, 9, salt_by=["id"], salts=salts).collect()
        assert sorted(salted) == sorted(plain)
    assert len(plain) == 27


def test_language_counts_ties_by_first_path(spark):
    df = files.eligible_files(make(spark, ["z.go", "b.rs", "a.py", "c.py"]))
    rows = [(r.language, r.file_count) for r in files.language_counts(df).collect()]
    assert rows == [("python", 2), ("rust", 1), ("go", 1)]


def test_scan_tree(spark, tmp_path):
    (tmp_path / "r1" / "src dir").mkdir(parents=True)
    (tmp_path / "r2").mkdir()
    (tmp_path / "r1" / "src dir" / "a+b%20.py").write_text("x = 1\n")
    (tmp_path / "r1" / "empty.py").write_text("")
    (tmp_path / "r2" / "b.go").write_bytes(b"a\x80\xffb")
    (tmp_path / "r2" / "big.go").write_text("x" * 102_401)
    assert scan_tree(spark, str(tmp_path)).where("path = 'big.go'").first().size == 102_401
    df = scan_tree(spark, str(tmp_path), limits=BOUNDED)
    rows = {(r.repo_id, r.path, r.size, r.content) for r in df.collect()}
    assert rows == {("r1", "src dir/a+b%20.py", 6, "x = 1\n"), ("r2", "b.go", 4, "a��b")}
    one = scan_tree(spark, str(tmp_path / "r1"), repo_id="x").collect()
    assert [(r.repo_id, r.path) for r in one] == [("x", "src dir/a+b%20.py")]
    every = {(r.repo_id, r.path): r.outcome for r in files.file_outcomes(
        scan_tree(spark, str(tmp_path), every_file=True), BOUNDED).collect()}
    assert every == {("r1", "src dir/a+b%20.py"): "eligible", ("r2", "b.go"): "eligible", ("r2", "big.go"): "too_large"}


def scanned(df):
    """(files, bytes) that the scan of an executed plan has opened."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return tuple(plan.metrics().apply(m).value() for m in ("numFiles", "filesSize"))


def test_scan_tree_opens_no_skipped_files(spark, tmp_path):
    for folder, size in (("r/src", 100), ("r/node_modules/x/y", 5_000), ("r/vendor", 7_000), ("r/dist", 900), ("r/lib", 50)):
        (tmp_path / folder).mkdir(parents=True)
        for name in ("m.py", "package-lock.json", "pic.png"):
            (tmp_path / folder / name).write_text("x" * size)
    kept = scan_tree(spark, str(tmp_path))
    rows = {r.path for r in kept.collect()}
    wanted = {p for p in ("src/m.py", "node_modules/x/y/m.py", "vendor/m.py", "dist/m.py", "lib/m.py")
              if not set(p.split("/")[:-1]) & set(rules.SKIP_DIRS)}
    assert rows == wanted and "src/m.py" in rows and "node_modules/x/y/m.py" not in rows
    opened, size = scanned(kept)
    assert opened == len(wanted) and size < 5_000 + 7_000 * ("vendor/m.py" in wanted)


def test_every_file_has_its_first_reason(spark):
    rows = [("r", "a.py", 5, "x = 1"), ("r", "b.py", 0, ""), ("r", "c.py", None, "x"), ("r", "d.py", 200_000, "x"),
            ("r", "e.txt", 5, "x"), ("r", "yarn.lock", 5, "x"), ("r", "f.min.js", 5, "x"), ("r", "node_modules/g.py", 5, "x"),
            ("r", "h.py", 5, None), ("r", "i.py", 5, " \n"), ("r", None, 5, "x"), ("r", "j.py", 5, "x"), ("s", "k.py", 5, "x")]
    df = spark.createDataFrame(rows, FILES)
    got = {r.path: r.outcome for r in files.file_outcomes(df, BOUNDED, max_files=1).collect()}
    assert got == {"a.py": "eligible", "b.py": "empty", "c.py": "empty", "d.py": "too_large", "e.txt": "no_language",
                   "yarn.lock": "no_language", "f.min.js": "skipped_name", "node_modules/g.py": "skipped_dir",
                   "h.py": "unreadable", "i.py": "blank", None: "unreadable", "j.py": "over_cap", "k.py": "eligible"}
    kept = {r.path for r in files.eligible_files(df, BOUNDED, max_files=1).collect()}
    assert kept == {p for p, o in got.items() if o == "eligible"}
    assert files.file_outcomes(df).count() == len(rows)


@pytest.mark.parametrize("sent", [1, 3, 200_000])
def test_cap_moves_no_contents(spark, monkeypatch, sent):
    monkeypatch.setattr(files, "CUTOFFS_SENT", sent)
    df = spark.range(400).select(F.concat(F.lit("r"), (F.col("id") % 9).cast("string")).alias("repo_id"),
                                 F.format_string("f%03d.py", "id").alias("path"), F.lit(5).cast("long").alias("size"),
                                 F.lit("x").alias("content"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = files.eligible_files(df, max_files=4)
        # The stage that holds contents ends in the result: no exchange stands above the joins with the cut-offs.
        plan = kept._jdf.queryExecution().executedPlan().toString().split("\n")
        joins = [i for i, line in enumerate(plan) if "BroadcastHashJoin" in line]
        assert len(joins) >= 1 and "SortMergeJoin" not in "".join(plan)
        assert not any("Exchange hashpartitioning" in line for line in plan[:joins[-1]])
        got = {r.path for r in kept.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {f"f{i:03d}.py" for i in range(36)}


def test_text_helpers(spark):
    df = spark.createDataFrame([(" \t a b \r\n",)], "t string")
    assert df.select(text.strip("t").alias("s")).first().s == "a b"
    tokens = spark.createDataFrame([("",), ("sum(a, b2)",), ("naïve_x 1.5",)], "t string")
    assert [r.n for r in tokens.select(text.token_count("t").alias("n")).collect()] == [0, 6, 4]


def test_chunk_id(spark):
    import hashlib

    df = spark.createDataFrame([("tools", "lib/trie.rb", 7), ("tools", "lib/trie.rb", 7),
                                ("tools", "lib/trie.rb", 8)], "r string, p string, n int")
    a, b, c = [r.i for r in df.select(text.chunk_id("r", "p", "n").alias("i")).collect()]
    assert a == b == hashlib.sha256(b"tools:lib/trie.rb:7").hexdigest()[:16]
    assert c != a
