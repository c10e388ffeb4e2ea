"""Small tables with every awkward case, shared by the tests of this folder."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, t string, k1 int"


def documents(spark, texts, ids=None, sources=None):
    """Documents with columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["a", "b", None] * len(texts)
    rows = [(i, t, None, s, None if t is None else len(t), "x", "y", 1) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng, n, vocabulary=400):
    words = [f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('rstv')}{k}" for k in range(vocabulary)]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward(seed=0):
    """NULL, empty, blank, tiny, repeated and very long texts."""
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    return [None, "", "   \n\t ", "one", "two words", same, same, prose(rng, 120), "ÄÖ é 日本 😀 x", long, "a\n" * 500]
