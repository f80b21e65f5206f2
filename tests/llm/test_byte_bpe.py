"""Distinct-word BPE against the library on whole texts, and the round trip back to bytes."""

import random

import numpy as np
import public_tokenizers
import pytest

from sourceloom.llm import byte_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, batch string, word string, ids string, place int, key string"


def check(df):
    whole = byte_bpe.encoder(RANKS, PATTERN)
    want = [(r.doc_id, np.array(whole.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode())
            for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.round_trip(df, RANKS, PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("table", ["docs", "odd_docs", "no_docs"])
def test_odd_tables(request, table):
    check(request.getfixturevalue(table))


def test_small_batches_white_space_scripts_and_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    pieces = ["don't", "we'll", "I'M", "  ", "\n", "\t\r\n", "\x1c", "\x1f", "\x85", "\xa0", "　", " 12", "34", "½", "٣", "été",
              "你好", "мир", "👩‍👩‍👧", "!!", "?! ", "'s", "''", " ", "​", "a" * 50, "İ", "ß", "\x00", "_", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["x" * 300_000, " " * 200_000 + "y", "ab cd " * 100_000, None, "", " ", "\n"]
    rows = [(i, t, "b", "w", "i", 1, "k") for i, t in enumerate(texts)] + [(None, "again and again", *["x"] * 3, 1, "k")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", 20_000)
    monkeypatch.setattr(byte_bpe, "LAZY_CHARS", 1_000)
    check(df)


def test_every_character_splits_like_the_library():
    own, whole = byte_bpe.splitter(PATTERN), byte_bpe.encoder(RANKS, PATTERN)
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}b 1{c}2 {c}" for c in chars[::7] + chars[:0x3100])
    assert [i for w in own.findall(text) for i in whole.encode_ordinary(w)] == whole.encode_ordinary(text)
    assert "".join(own.findall(text)) == text


def test_decode_and_id_lists(spark, docs):
    ids = byte_bpe.encoder(RANKS, PATTERN).encode_ordinary("Grüße, 世界 and more")
    packed = lambda v: np.array(v, "<u4").tobytes()
    rows = [("a", packed(ids)), ("b", b""), ("c", packed(ids[::-1] + [999_999, 2**32 - 1])), ("d", None)]
    encoded = spark.createDataFrame(rows, "key string, ids binary")
    got = {r.key: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect()}
    table = {v: k for k, v in byte_bpe.read_ranks(RANKS).items()}
    assert got == {"a": "Grüße, 世界 and more".encode(), "b": b"", "c": b"".join(table[i] for i in ids[::-1]), "d": None}
    lists = byte_bpe.id_lists(byte_bpe.encode(docs, RANKS, PATTERN))
    whole = byte_bpe.encoder(RANKS, PATTERN)
    assert {(r.doc_id, tuple(r.ids)) for r in lists.collect()} == {
        (r.doc_id, tuple(whole.encode_ordinary(r.text or ""))) for r in docs.collect()}


def test_every_distinct_word_is_encoded_once(spark, docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", 500)
    monkeypatch.setattr(byte_bpe, "ANSWER_IDS", 100)
    asked = byte_bpe.requests(byte_bpe.split(docs, PATTERN, "doc_id", "text").where("part = 'words'")).cache()
    answers = byte_bpe.encode_words(asked, RANKS, PATTERN).collect()
    assert sum(len(byte_bpe._unpacked(r.places)) for r in answers) == asked.count() > asked.select("word").distinct().count()


def test_packed_numbers():
    for numbers in ([], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 0, 5]):
        assert byte_bpe._unpacked(byte_bpe._packed(np.array(numbers, np.uint32))).tolist() == numbers
    with pytest.raises(ValueError):
        byte_bpe._packed(np.array([2**28], np.uint32))
