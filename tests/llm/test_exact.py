"""Operators against plain versions, on small tables with every kind of odd row."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import (bwt_merge, flow_shards, jaccard_join, merkle, packing, quality_rules, suffix_tree,
                            wu_manber)
from tests.llm import brute

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "odd_docs", "no_docs"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("length", [12, 35])
def test_suffix_tree(table, length):
    got = collected(suffix_tree.remove_repeats(table, length), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.word_repeats(rows_of(table), length), key=str)


def test_suffix_tree_splits_large_groups(docs, monkeypatch):
    from sourceloom.llm import repeats

    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", 4)
    for module, plain, length in ((suffix_tree, brute.word_repeats, 12), (bwt_merge, brute.byte_repeats, 40)):
        columns = ["doc_id", *(c for c in ("n_words", "n_bytes", "n_removed", "n_spans", "kept_sha256"))]
        df = module.remove_repeats(docs, length)
        got = collected(df, *[c for c in columns if c in df.columns])
        assert got == sorted(plain(rows_of(docs), length), key=str)


@pytest.mark.parametrize("length", [40, 200])
def test_bwt_merge(table, length):
    got = collected(bwt_merge.remove_repeats(table, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.byte_repeats(rows_of(table), length), key=str)


def test_without_repeats_keeps_columns_and_untouched_texts(odd_docs):
    got = suffix_tree.without_repeats(odd_docs, 35)
    assert got.columns == odd_docs.columns
    before = {(r.doc_id, r.text) for r in odd_docs.collect()}
    removed = {r.doc_id for r in suffix_tree.remove_repeats(odd_docs, 35).where("n_removed > 0").collect()}
    assert {(r.doc_id, r.text) for r in got.collect() if r.doc_id not in removed} <= before


ITEMS = [(1, "Ab cd, ef gh ij kl mn op qr st uv"), (2, "only three words"), (3, None), (None, "zz"), (2, "only three words"),
         (9, "a b c d e f g h i j k l a b c d e f g h i j k l")]


def test_wu_manber(spark, table, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    extra = spark.createDataFrame(
        [(900 + i, t) for i, t in enumerate(["x AB-CD ef gh ij kl mn op qr st uv ONLY three words y", "zz", "only three wordsx",
                                             "a b c d e f g h i j k l a b c d e f g h i j k l m", "1 2 3"])],
        "doc_id long, text string")
    both = table.select("doc_id", "text").union(extra)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = sorted(brute.contamination(rows_of(both), ITEMS), key=str)
    assert collected(wu_manber.contamination(both, benchmark), *columns) == expected
    monkeypatch.setattr(wu_manber, "BLOCK_BYTES", 200)         # several passes
    assert collected(wu_manber.contamination(both, benchmark), *columns) == expected
    nothing = wu_manber.contamination(both, benchmark.limit(0))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == both.count()
    clean = wu_manber.clean_only(table, benchmark)
    assert clean.columns == table.columns


def test_wu_manber_keeps_ends_of_hits_of_several_passes_together(spark, monkeypatch):
    items = [(i, " ".join(f"p{i}x{j}" for j in range(10))) for i in range(12)]
    items += [(20 + i, " ".join(t.split()[:3 + i % 5])) for i, t in items]          # same start, other end
    other = " ".join(f"w{j}" for j in range(40))
    rows = [(i, f"{other} {items[i % 12][1]} {other} {items[(i * 5 + 1) % 12][1]} tail") for i in range(30)]
    rows += [(50 + i, f"lead {items[12 + i][1]} {other} {items[i][1]}") for i in range(12)] + [rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = sorted(brute.contamination(rows, items), key=str)
    assert collected(wu_manber.contamination(docs, benchmark), *columns) == expected
    monkeypatch.setattr(wu_manber, "BLOCK_BYTES", 700)
    assert collected(wu_manber.contamination(docs, benchmark), *columns) == expected


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 70)])
def test_jaccard_join(table, k, percent):
    rows = rows_of(table)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(table, k, percent).collect()}
    if any(d is None for d, _ in rows) or len({d for d, _ in rows}) < len(rows):
        assert len(got) <= len(rows)
        return
    assert got == set(brute.similar(rows, k, percent))


def test_jaccard_join_with_frequent_shingles_and_poor_bands(docs, monkeypatch):
    expected = set(brute.similar(rows_of(docs), 3, 90))

    def got():
        return {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 3, 90).collect()}

    monkeypatch.setattr(jaccard_join, "SAMPLE_DOCS", 40)
    assert got() == expected
    monkeypatch.setattr(jaccard_join, "frequent_slots", lambda docs, k, count: np.arange(1 << 22) % 2 == 0)
    assert got() == expected
    monkeypatch.setattr(jaccard_join, "_segments", lambda tokens, needed: needed)      # many sets fill too few of them
    assert got() == expected


def test_jaccard_join_compares_no_chance_pairs_and_no_settled_copies(spark, monkeypatch):
    words = [[f"w{i}x{j}" for j in range(300)] for i in range(24)]
    for i, j in ((i, j) for i in range(24) for j in range(i)):
        words[i][12 * j:12 * j + 3] = words[j][12 * i:12 * i + 3] = [f"pair{i}x{j}x{p}" for p in range(3)]     # one shingle
    copies = [[w if j != 20 * i else "other" for j, w in enumerate(words[0])] for i in range(1, 13)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words + copies)]
    compared, across = [], jaccard_join._across

    def spy(members, *rest):
        compared.append(members.count())
        return across(members, *rest)

    monkeypatch.setattr(jaccard_join, "_across", spy)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {(i, 0 if i >= 24 else i) for i in range(36)}
    assert compared == [0]


def test_one_of_each(odd_docs, docs):
    for table in (odd_docs, docs):
        kept = jaccard_join.one_of_each(table, 3, 90)
        assert kept.columns == table.columns
        found = jaccard_join.join(table, 3, 90)
        groups = found.where("n_shingles > 0").select(F.coalesce("component", "cls")).distinct().count()
        assert kept.count() == groups + found.where("n_shingles = 0").count()


def plain_quality(text):
    w = brute.words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_rules(table):
    found = quality_rules.apply_rules(table).select(
        "text", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        "quality.base_failed", "quality.kept").collect()
    assert len(found) == table.count()
    for r in found:
        assert tuple(r)[1:-1] == plain_quality(r.text)
        assert not (r.kept and r.base_failed)
    assert quality_rules.keep_good(table).columns == table.columns


def test_quality_plan_is_native(docs):
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_rules_reject_each_kind(spark):
    good = "the house of the river and a bird is in the tree with some fruit that was for us " * 1
    words = [f"{w}{i}" if len(w) > 3 else w for i, w in enumerate((good * 5).split())]
    texts = [" ".join(words), " ".join(w + "$$$" for w in words), " ".join(words).upper(),
             " | ".join(w for w in words if len(w) > 3) * 1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = [r.kept for r in quality_rules.apply_rules(df).orderBy("doc_id").select("quality.kept").collect()]
    assert kept == [True, False, False, False]


def test_packing_round_trip(table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(table, TOKENIZER, window=64).collect()
    expected = sorted(b"".join(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for t in [t])
                      for _, t in rows_of(table))
    by_sequence = {}
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_sequence.setdefault(p.sequence_id, []).append(p)
    total = 0
    for group in by_sequence.values():
        group.sort(key=lambda p: p.offset)
        assert [p.offset for p in group] == list(np.cumsum([0] + [p.length for p in group])[:-1])
        assert sum(p.length for p in group) <= 64
        total += sum(p.length for p in group)
    assert total == sum(len(e) for e in expected) // 4
    assert sum(sum(p.length for p in g) < 64 for g in by_sequence.values()) <= 1        # one shard here
    ids = [d for d, _ in rows_of(table)]
    if len(set(ids)) == len(ids) and None not in ids:
        whole = {}
        for p in sorted(pieces, key=lambda p: p.start):
            whole[p.doc_id] = whole.get(p.doc_id, b"") + p.ids
        assert sorted(whole.values()) == expected


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|startoftext|> c", "I'm don't été İ ΣΣ x y z", "1234 a1b2 ---..", ""])
def test_encoder_matches_tokenizer(text):
    encoder = packing.Encoder(TOKENIZER)
    assert encoder(text, 2).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_encoder_cuts_rows_like_the_tokenizer():
    import random

    encoder, draw = packing.Encoder(TOKENIZER), random.Random(3)
    texts = ["".join(draw.choices("aB'|<>.,é\u0301 \n1ß…\"«Σ!", k=draw.randint(0, 90))) for _ in range(2000)]
    texts += ["x" * 500 + "'s!a", "a<|endoftext|>b <|ENDOFTEXT|>", "", "don't it'sTime\u00a0x\x0by"]
    for first in range(0, len(texts), 40):
        part = texts[first:first + 40]
        raw = [t.encode() for t in part]
        ids, bounds = encoder.rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]), 2)
        for a, b, code in zip(bounds, bounds[1:], encoder.tokenizer.encode_batch(part, add_special_tokens=False)):
            assert ids[a:b].tolist() == code.ids + [2]


def test_packing_prefers_neighbours():
    a, b = np.arange(100, 140, dtype=np.uint32), np.arange(500, 540, dtype=np.uint32)
    documents = [np.append(a, 2), np.append(b, 2), np.append(b[::-1][:30], 2), np.append(a[::-1][:30], 2)]
    pieces = packing.pack_shard(documents, 72)
    assert {(p[0], p[3]) for p in pieces} == {(0, 0), (3, 0), (1, 1), (2, 1)}


def test_packing_asks_all_documents_with_all_terms(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(packing, "ROUND_SEEDS", 7)
    monkeypatch.setattr(packing, "SHARD_BYTES", 1 << 10, raising=False)
    rows = sorted((d, t or "") for d, t in rows_of(docs))
    encoder = packing.Encoder(TOKENIZER)
    ids = [encoder(t, 2) for _, t in rows]
    total, n = sum(len(i) for i in ids), len(ids)
    df = {}
    for i in ids:
        for t in set(i.tolist()):
            df[t] = df.get(t, 0) + 1

    def score(seed, other):
        counts = dict(zip(*np.unique(ids[other], return_counts=True)))
        norm = 1.2 * (0.25 + 0.75 * len(ids[other]) * n / total)
        return sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * counts[t] * 2.2 / (counts[t] + norm)
                   for t in set(ids[seed].tolist()) & set(counts))

    number = {d: i for i, (d, _) in enumerate(rows)}
    sequences = {}
    for p in packing.pack(docs, TOKENIZER, window=512).collect():
        sequences.setdefault(p.sequence_id, []).append((p.offset, number[p.doc_id], p.length))
    left, asked = {i: len(x) for i, x in enumerate(ids)}, 0
    for _, sequence in sorted(sequences.items()):
        pieces = [(d, length) for _, d, length in sorted(sequence)]
        seed = pieces[0][0]
        left[seed] -= pieces[0][1]
        for d, length in pieces[1:]:
            assert left[d] and d != seed
            best = max(score(seed, o) for o in left if left[o] and o != seed)
            assert score(seed, d) >= best * (1 - 1e-5)
            left[d] -= length
            asked += 1
    assert asked > 20 and not any(left.values())


def test_reshard(table):
    rows = rows_of(table)
    out = flow_shards.reshard(table, F.pmod(F.xxhash64("source"), F.lit(3)).cast("int"), [1] * 4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    largest = max((r.size for r in out), default=0)
    loads = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= 4 * largest
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        old = {int(s): int(x) for s, x in zip(rng.choice(9, 5, replace=False), rng.integers(0, 90, 5))}
        capacities = rng.integers(0, 4, 7).tolist() + [1]
        demand = flow_shards.shares(sum(old.values()), capacities)
        plan = flow_shards.transfers(old, capacities)
        assert sum(b - a for s, a, b, j in plan if s != j) == sum(old.values()) - sum(
            min(x, demand[s]) for s, x in old.items() if s < len(demand))
        for j, d in enumerate(demand):
            assert sum(b - a for _, a, b, k in plan if k == j) == d


def test_min_cost_flow_takes_flow_back():
    cost = [[1, 2], [1, 9]]
    assert flow_shards.min_cost_flow([5, 5], [5, 5], lambda i, j: cost[i][j]) == {(0, 1): 5, (1, 0): 5}


def test_rewrite_touches_changed_shards_only(spark, tmp_path):
    paths = {}
    for s in range(3):
        paths[s] = f"{tmp_path}/old{s}"
        spark.range(s * 10, s * 10 + 10).withColumn("v", F.lit(s)).write.parquet(paths[s])
    plan = spark.range(30).select("id", F.floor(F.col("id") / 10).cast("int").alias("old"),
                                  F.when(F.col("id") == 3, 1).otherwise(F.floor(F.col("id") / 10)).cast("int").alias("shard"))
    new = flow_shards.rewrite(spark, paths, "old", plan, f"{tmp_path}/new", ["id"])
    assert new[2] == [paths[2]] and new[0] != [paths[0]]
    assert sorted(r.id for r in spark.read.parquet(*new[1]).collect()) == [3, *range(10, 20)]


def test_rewrite_writes_every_copy_once(spark, tmp_path):
    ids = {0: [1, 1, 1, 1, None, None, 2], 1: [1, None, 3, 3], 2: [4]}
    paths = {}
    for s, own in ids.items():
        paths[s] = f"{tmp_path}/old{s}"
        spark.createDataFrame([(i,) for i in own], "id long").write.parquet(paths[s])
    plan = [(i, s, (n % 2) if s < 2 else s) for s, own in ids.items() for n, i in enumerate(own)]
    assignment = spark.createDataFrame(plan, "id long, old int, shard int")
    new = flow_shards.rewrite(spark, paths, "old", assignment, f"{tmp_path}/new", ["id"])
    assert new[2] == [paths[2]]
    for s in (0, 1, 2):
        got = [r.id for r in spark.read.parquet(*new[s]).collect()]
        assert sorted(got, key=str) == sorted((i for i, _, to in plan if to == s), key=str)


PAGES = "page_id long, url string, html string, file long, hash string"


def test_merkle_audit(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 9), i, "h") for i in range(300)] + [(None, None, None, 1, "h"), (7, "u", "", 0, "")]
    left = spark.createDataFrame(rows, PAGES)
    right = left.withColumn("html", F.when(F.col("page_id").isin(5, 77, 299), "bad").otherwise(F.col("html")))
    files = 4
    a, b = (merkle.leaves(x, files) for x in (left, right))
    found = merkle.audit(a, b).collect()
    assert {r.left_page_id for r in found} == {5, 77, 299} and {r.status for r in found} == {"changed"}
    assert merkle.audit(a, a).count() == 0
    assert merkle.audit(a, a.limit(0)).count() == len(rows)
    assert {r.status for r in merkle.audit(a.limit(0), a).select("status").distinct().collect()} == {"missing_left"}
    assert merkle.audit(a.limit(0), a.limit(0)).count() == 0


def plain_audit(left, right):
    """(id, status) of records that differ, from the contents of two lists of (id, url, body)."""
    found = []
    for key in {r[:2] for r in left + right}:
        sides = [Counter((r[0], r[1], r[2] or "") for r in side if r[:2] == key) for side in (left, right)]
        more = [list(sides[0] - sides[1]), list(sides[1] - sides[0])]
        for i in range(max(map(len, more))):
            found.append((key[0], "missing_left" if i >= len(more[0]) else "missing_right" if i >= len(more[1]) else "changed"))
    return sorted(found, key=str)


def test_merkle_audit_locates_lost_added_and_repeated_records(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 9)) for i in range(600)]
    rows += [(7, "http://x/7", "again")] * 40 + [(None, f"n{i}", "b") for i in range(50)]
    rows += [(8, "http://x/8", f"v{i}") for i in range(300)]               # one id and address, many contents
    other = [r for r in rows if r[0] != 100 and r[1] != "n9"]             # two lost records
    other = [(i, u, "cut" if i in (200, 201) else b) for i, u, b in other] + [(9999, "new", "page"), (7, "http://x/7", "again")]
    other[other.index((8, "http://x/8", "v13"))] = (8, "http://x/8", "other")
    schema = "page_id long, url string, html string"
    a, b = (merkle.leaves(spark.createDataFrame(r, schema).repartition(3), 3) for r in (rows, other))
    found = merkle.audit(a, b).collect()
    assert sorted(((r.page_id, r.status) for r in found), key=str) == plain_audit(rows, other)
    assert merkle.differing(merkle.tree(a, 300), merkle.tree(b, 300)).count() <= 7
    assert len(found) == 7 and {r.right_copies for r in found if r.page_id == 7} == {1}
    spans = sorted((r.file, r.offset, r.offset + r.size * r.copies) for r in a.collect())
    assert all(x[2] == y[1] if x[0] == y[0] else y[1] == 0 for x, y in zip(spans, spans[1:]))


def test_repeated_rows_share_their_ranges(spark):
    """2,500 rows of one id and text, and a copy under another id."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.range(2500).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = rows.union(spark.createDataFrame([(2, text + " end"), (3, "short")], "doc_id long, text string"))
    for module, length in ((suffix_tree, 35), (bwt_merge, 200)):
        got = module.remove_repeats(rows, length).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("n_removed").alias("kinds"), F.max("n_removed").alias("m")).collect()
        whole = 300 if module is suffix_tree else len(text)
        assert {(r.doc_id, r.n, r.kinds, r.m) for r in got} == {(1, 2500, 1, whole), (2, 1, 1, whole), (3, 1, 1, 0)}


def test_filters_keep_columns_of_any_name(spark, odd_docs):
    names = ("_key", "_one", "key", "one", "row", "g", "best", "a.b")
    table = odd_docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for got in (jaccard_join.one_of_each(table, 3, 90),
                wu_manber.clean_only(table, spark.createDataFrame(ITEMS, "item_id long, text string"))):
        assert got.columns == table.columns
        kept = got.collect()
        assert kept and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in kept for c in names)


def test_sketches_put_off_no_link():
    draw = np.random.default_rng(5)
    for percent in (70, 80, 90):
        for n in (1, 2, 3, 7, 40, 255, 256, 600):
            for _ in range(20):
                first = draw.integers(0, 1 << 63, n, dtype=np.uint64)
                second = np.unique(np.concatenate([first[draw.random(n) < 0.95], draw.integers(0, 1 << 63, n // 12, dtype=np.uint64)]))
                first = np.unique(first)
                both = len(np.intersect1d(first, second))
                if not both or 100 * both < percent * (len(first) + len(second) - both):
                    continue
                sets = object.__new__(jaccard_join.Sets)
                sets.sets, sets.sizes = [first, second], np.array([len(first), len(second)])
                sets.flat = np.concatenate(sets.sets)
                a, b = sets.sketches().to_pylist()
                bits = int(jaccard_join.sketch_bits(sets.sizes).min())
                apart = jaccard_join.distances(jaccard_join.buckets([a], bits), jaccard_join.buckets([b], bits))
                assert jaccard_join.may_link(percent, apart, sets.sizes[:1], sets.sizes[1:]).all()


def test_packing_does_not_search_for_seeds_that_are_taken(spark, monkeypatch):
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ay", "ee", "oo", "ar", "ing", "ock")]
    draw, texts = np.random.default_rng(8), []
    for i in range(24):
        topic = draw.choice(words, 30)
        texts += [" ".join(draw.choice(topic, 150 + int(draw.integers(40)))) for _ in range(8)]
    searched, ask = [], packing._ask

    def spy(queries, *rest):
        searched.append(len(queries))
        return ask(queries, *rest)

    monkeypatch.setattr(packing, "_ask", spy)
    monkeypatch.setattr(packing, "LEAST_BATCH", 6, raising=False)
    monkeypatch.setattr(packing, "STRIP", 10, raising=False)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(rows, TOKENIZER, window=1200).collect()
    assert sum(p.length for p in pieces) == sum(len(packing.encoder(TOKENIZER)(t, 2)) for t in texts)
    assert sum(searched) < len(texts) / 2


@pytest.mark.parametrize("need", [60, 900])
def test_packing_lists_are_those_of_a_plain_search(monkeypatch, need):
    draw = np.random.default_rng(need)
    topics = [draw.choice(3000, 60) for _ in range(6)]
    documents = [np.append(draw.choice(topics[i % 6], int(n)), 2) for i, n in enumerate(draw.integers(1, 120, 400))]
    terms, counts = zip(*(np.unique(d, return_counts=True) for d in documents))
    sizes = np.array([len(d) for d in documents])
    df = np.bincount(np.concatenate(terms))
    statistics = packing.Statistics(400, int(sizes.sum()), np.flatnonzero(df), df[df > 0])
    monkeypatch.setattr(packing, "STRIP", 37)
    monkeypatch.setattr(packing, "GROUP", 9)
    rows = [{"width": 4, "terms": t.astype(np.uint32).tobytes(), "counts": c.astype(np.uint32).tobytes(), "size": int(s), "mark": 0,
             "mid": i, "weight": float(statistics.weights(t, c, s).sum())} for i, (t, c, s) in enumerate(zip(terms, counts, sizes))]
    rows.sort(key=lambda r: -r["weight"])
    unused = draw.random(400) < 0.8
    seeds = np.flatnonzero(unused)
    keys = np.array([statistics.key(terms[s], counts[s]) for s in seeds])
    nearby = packing.Nearby(keys, [terms[s] for s in seeds], [counts[s] for s in seeds], sizes[seeds], statistics)
    least = nearby.least(np.arange(len(seeds)), need)
    ask = packing._ask([terms[s] for s in seeds], least, need, len(df), np.packbits(~unused, bitorder="little"), np.array([0]), np.array([0]))
    found = [b for part in (rows[0::2], rows[1::2]) for b in ask(packing._strips(statistics)(iter([pa.RecordBatch.from_pylist(part)])))]
    merged = pa.Table.from_batches(list(packing._merge(need)(iter(found))))
    assert (least >= 0).sum() > 100
    for i, seed in enumerate(seeds):
        mine = merged.filter(pc.equal(merged["seed"], i)).sort_by("rank")["mid"].to_numpy()
        score = np.array([sum(statistics.weights(t, c, s)[np.isin(t, terms[seed])]) for t, c, s in zip(terms, counts, sizes)])
        best = seeds[np.argsort(-score[seeds], kind="stable")]
        length = max(int(np.searchsorted(np.cumsum(sizes[best]), need)) + 1, packing.DEPTH)
        assert np.allclose(score[mine], score[best[:len(mine)]], rtol=1e-5) and len(set(mine)) == len(mine)
        assert len(mine) == min(length, len(best)) or sizes[mine].sum() >= need


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_jaccard_signatures_are_shared_whatever_counts_as_frequent(percent):
    draw, table, pairs = np.random.default_rng(percent), jaccard_join.bands(percent), 0
    for _ in range(250):
        n = int(draw.choice([3, 9, 20, 60, 150, 400]))
        first = draw.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
        second = np.concatenate([first[draw.random(n) < draw.choice([0.85, 0.93, 0.98])],
                                 draw.integers(0, 1 << 63, int(draw.integers(0, n // 10 + 2)), dtype=np.uint64) << np.uint64(1)])
        both = [np.unique(first), np.unique(second)]
        common = len(np.intersect1d(*both))
        if np.array_equal(*both) or not common or 100 * common < percent * (len(both[0]) + len(both[1]) - common):
            continue
        # All shingles, none, a random share, or those that the two hold in common count as frequent.
        frequent = np.zeros(1 << jaccard_join.FREQUENT_BITS, bool)
        share = draw.choice([0, 0.1, 0.5, 0.9, 0.97, 1])
        held = np.intersect1d(*both) if draw.random() < 0.3 else np.union1d(*both)
        frequent[(held[draw.random(len(held)) < share] >> np.uint64(64 - jaccard_join.FREQUENT_BITS)).astype(np.int64)] = True
        sets = object.__new__(jaccard_join.Sets)
        sets.sets, sets.sizes, sets.flat = both, np.array([len(b) for b in both]), np.concatenate(both)
        sets.bounds = np.concatenate([[0], np.cumsum(sets.sizes)])
        finer = {}
        while True:
            row, sig, poor, need = jaccard_join.signatures(sets, percent, table, frequent, finer)
            if not len(poor):
                break
            finer |= {int(b): 4 * finer.get(int(b), 1) for b in poor}
        assert len(np.intersect1d(sig[row == 0], sig[row == 1])) >= need.max()
        pairs += 1
    assert pairs > 60
