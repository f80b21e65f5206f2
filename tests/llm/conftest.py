import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, lo string, quality string"


def corpus(seed: int, size: int = 60) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, odd and missing texts, ties and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéñ") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(size):
        w = [word() for _ in range(rng.choice([1, 2, 5, 30, 80, 200]))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10):rng.randint(45, 60)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
        if i % 5 == 0:
            near = list(w)
            near[rng.randrange(len(near))] = word()
            texts += [" ".join(near), " ".join(w).upper(), texts[-1]]
    texts += [None, "", " \n\t ", "ß", "the the the the the the", "x " * 3000, "\n".join(["same line here"] * 60)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, i, "clash", "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(3), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows, one id with two texts, null in every column."""
    rows = corpus(4, 20)
    rows += [rows[3], rows[3], (None, "a b c d e f g", *rows[0][2:]), (None, None, *[None] * 6), (5, "another text", *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
