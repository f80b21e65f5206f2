"""Classifiers and the pipeline: held-out accuracy, odd rows, and the order of decisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import oracles, queries, subword

RNG = np.random.default_rng(2)
PLAIN = ["river", "house", "winter", "garden", "walk", "paper", "letter", "stone", "music", "yellow"]


def labelled(n, marks):
    texts, labels = [], []
    for i in range(n):
        w = list(RNG.choice(PLAIN, 40))
        if i % 3 == 0:
            w[int(RNG.integers(40))] = str(RNG.choice(marks))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_subwords_reach_unseen_spellings():
    settings = subword.Settings(segment=6, longest=4, epochs=6)
    texts, labels = labelled(600, ["scoundrel", "blockhead"])
    model = subword.train(texts, labels, settings)
    unseen, truth = labelled(300, ["scoundrell", "scoundre1s", "blokhead", "BLOCKHEAD"])
    assert np.mean((model.scores(unseen) >= 0.7) == np.array(truth)) > 0.95


def test_markers_see_repetition():
    settings = subword.Settings(fold_case=False, markers=True, epochs=5)
    texts, labels = [], []
    for i in range(200):
        w = [f"{a}{b}" for a, b in zip(RNG.choice(PLAIN, 60), RNG.integers(0, 99, 60))]
        texts.append(" ".join(w if i % 2 else w[:6] * 10))
        labels.append(i % 2)
    model = subword.train(texts[:150], labels[:150], settings)
    assert np.mean((model.scores(texts[150:]) >= 0.5) == np.array(labels[150:])) > 0.9


@pytest.mark.parametrize("texts", [[], [""], ["", " ", "a", "a a a a a a a a", "😀 x"], ["w " * 50_000]])
def test_scores_of_odd_texts(texts):
    model = subword.train(*labelled(30, ["scoundrel"]), subword.Settings(segment=6, markers=True, epochs=1))
    scores = model.scores(texts)
    assert len(scores) == len(texts) and ((scores >= 0) & (scores <= 1)).all()


def test_one_label_only():
    model = subword.train(["a b", "c d"], [1, 1], subword.Settings())
    assert np.allclose(model.scores(["x", ""]), 2.5 / 3)
    assert np.allclose(subword.train([], [], subword.Settings()).scores(["x"]), 0.5)


def test_score_table(spark, odd_docs, no_docs):
    model = subword.train(*labelled(30, ["scoundrel"]), subword.Settings(epochs=1))
    assert subword.score(odd_docs, model).where("score between 0 and 1").count() == odd_docs.count()
    assert subword.score(no_docs, model).count() == 0


def test_training_rows_leave_the_fold_out(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(60)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = subword.in_fold("doc_id", 3, 1)
    texts, y, _ = subword.training_rows(docs, labels, "toxic", held)
    out = {str(r.doc_id) for r in docs.where(held).collect()}
    assert texts and not set(texts) & out and len(texts) == len(y)
    assert len(subword.training_rows(docs, labels, "toxic", held, 4)[0]) == 8


def test_training_rows_take_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(0, f"copy {i}") for i in range(200)] + [(i, str(i)) for i in range(1, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    texts, y, _ = subword.training_rows(docs, labels, "toxic", F.lit(False), 10)
    assert sorted(texts) == sorted(["copy 99", *map(str, range(1, 20))]) and sum(y) == 10


@pytest.mark.parametrize("name,label,fold,threshold", [
    ("op6_toxicity", "toxic", (3, 1), 0.7), ("op8_quality_classifier", "quality", (5, 0), 0.3)])
def test_held_out_accuracy(spark, name, label, fold, threshold):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.REGISTRY[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id") \
        .where("held_out").select("score", "predicted", label).toPandas()
    assert (found["predicted"] == (found["score"] >= threshold)).all()
    assert np.mean(found["predicted"] == found[label]) > 0.95


def test_queries_run_and_match_sql(spark, sf_dir):
    from suite import check

    con = check.database(sf_dir)
    for name, statement in oracles.sql().items():
        assert check.compare(queries.REGISTRY[name](spark, sf_dir), con, statement) is None, name


def test_pipeline(spark, docs, odd_docs, no_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [("the tree of life and a house in the wood is old " + " ".join(f"word{d}x{i}" for i in range(60))) for d in range(12)]
    passage = " ".join(f"shared{i}" for i in range(40))
    texts = good + [good[0], good[1] + " tail", good[2] + " a b c d e f g h i j k", good[3] + " " + passage,
                    "the cat and the dog of it is in a box " + passage + " " + " ".join(f"z{i}" for i in range(40)), "short"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        table = out
    assert 17 not in seen["quality rules"] and len(seen["quality rules"]) == 17
    assert set(seen["n-gram Jaccard join"]) == set(range(12)) | {14, 15, 16} - {14} or 12 not in seen["n-gram Jaccard join"]
    assert all("shared5" not in t for t in seen["substring dedup"].values())
    assert all(" a b c d e f g h i j k" not in t for t in seen["benchmark decontamination"].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for table in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, str(tmp_path))
        assert table.count() >= 0


