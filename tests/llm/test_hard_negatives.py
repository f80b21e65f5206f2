"""Angular triangle filtering against a plain version."""

import math
import random

import numpy as np
import pytest

from sourceloom.llm import hard_negatives
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, score string, anchor string, angles int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(seed, count=600, dims=8, kinds=3, spread=0.4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(kinds)]
    rows = []
    for i in range(count):
        v = [c + rng.gauss(0, spread) for c in centres[i % kinds]]
        length = math.sqrt(sum(x * x for x in v))
        rows.append((i, [float(np.float32(x / length)) for x in v], rng.randrange(4)))
    return rows


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in hard_negatives.mine(df).select(*COLUMNS).collect()), key=str)
    assert got == sorted(brute.hard_negatives(rows), key=str)
    return got


@pytest.mark.parametrize("seed,dims,spread", [(1, 8, 0.4), (2, 3, 0.1), (3, 16, 2.0)])
def test_same_as_plain(spark, seed, dims, spread):
    assert check(spark, vectors(seed, dims=dims, spread=spread))


def test_ties_copies_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 8 * (9 + 32) * 3)        # three anchors a block
    monkeypatch.setattr(hard_negatives, "STRIP", 7)
    rows = vectors(5, 800, 8)
    rows += [(1000 + i, rows[i % 5][1], i % 3) for i in range(300)]               # ties of other ids
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2100, [0.1, None], 1), (2200, [nan] * 8, 1), (2300, [inf] * 8, 2), (2400, [0.5] * 8, None),
             (2500, [], 1), (2600, [0.0] * 8, 2), (2700, [0.9, 0.1], 1), (2800, [0.9] * 9, 1), (2900, [-0.3] * 8, 3)]
    check(spark, rows, 5)


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(6, 150, 4)
    rows += [rows[100]] * 12 + [rows[0]] * 2
    rows += [(None, rows[100][1], 2), (None, rows[3][1], 1)]
    check(spark, rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(x * 3e6)) for x in v], label) for i, v, label in vectors(7, 300, 6)]
    check(spark, rows)
    over = [(i, [float(np.float32(x * 1e30)) for x in v], label) for i, v, label in vectors(7, 300, 6)]
    df = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in over], SCHEMA)
    assert hard_negatives.mine(df).count() == 0


def test_no_rows_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty).columns == COLUMNS and hard_negatives.mine(empty).count() == 0
    assert check(spark, [(i, v, label) for i, v, label in vectors(8, 90) if i]) == []


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(1)
    whole = np.floor(256 * rng.normal(size=(4000, 5)) * rng.uniform(0, 2, (4000, 1))).astype(np.int64)
    norms = np.sqrt((whole.astype(float) ** 2).sum(1))
    centres = hard_negatives.references(whole)
    units = whole / np.maximum(norms, 1e-300)[:, None]
    angles = np.arccos(np.clip(units @ centres.T, -1, 1)).astype(np.float32).astype(float)
    order = np.lexsort((angles.min(1), angles.argmin(1)))
    skipped = total = 0
    for at in range(0, 4000, 64):
        rows = order[at:at + 64]
        low, high = hard_negatives.bounds(norms[:50], angles[:50], norms[rows], angles[rows])
        true = hard_negatives.scores(whole[:50], whole[rows])
        assert (low[:, None] <= true).all() and (true <= high[:, None]).all()
        skipped += (high < 0.9 * norms[:50] ** 2).sum()
        total += 50
    assert skipped > total / 10         # 18 % here, where norms vary a lot inside a strip
