import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids long, bucket long, kind int, block binary, rest string, score double, twin long"


def make(spark, texts):
    """Rows of documents with further columns whose names clash with those that operators use inside."""
    rows = [(i, t, None if i is None or i % 3 == 0 else "en", "s", len(t or ""), 1, 2, 3, b"x", None, 0.5, 9) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd signs, empty, null and long ones."""
    r = random.Random(11)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "ñ", "é"]) for _ in range(r.randrange(1, 5)))
    words = lambda n: " ".join(word() for _ in range(n))
    passage, line = words(60), "All rights reserved."
    texts = [words(r.randrange(1, 300)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " tail", "x " + texts[2]]
    for i in range(6):
        near = texts[3 + i].split(" ")
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    texts += [words(20) + "\n" + passage + "\n" + words(20) for _ in range(5)]
    texts += [words(30) + "\n" + line, "Licensed under the Apache License, Version 2.0.", "released   under the MIT license"]
    texts += ["", None, " ", "\n\t", "a", "a b c", "A B C", "!" * 700, "ab " * 900, "naïve — “quotes” \U0001f642 日本語\r\n", "A<|endoftext|>b", words(4000), "x" * 5000]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
