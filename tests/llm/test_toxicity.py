"""Toxicity: segments beside brute force, held-out accuracy, and what must not be learned from."""

import random
import zlib

import numpy as np
from helpers import awkward, documents, prose

from dqspark.llm.toxicity import Model, calibration, judge_toxicity, maximal_segments, segment_decay

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def brute(scores):
    """Repeatedly the best segment (the shortest of equal ones, leftmost), then the same on either side of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            key = (-sum(scores[i:j]), j - i, i)
            if sum(scores[i:j]) > 0 and (best is None or key < best[0]):
                best = (key, i, j)
    if best is None:
        return []
    _, i, j = best
    right = [(a + j, b + j, s) for a, b, s in brute(scores[j:])]
    return [*brute(scores[:i]), (i, j, sum(scores[i:j])), *right]


def test_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.randrange(-4, 5) + rng.random() / 1000 for _ in range(rng.randrange(0, 14))]
        got = [(s.start, s.end, round(s.score, 6)) for s in maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute(scores)], scores


def test_statistics():
    scores, counts = np.array([-1.0, 1.0]), np.array([3.0, 1.0])
    assert abs(segment_decay(scores, counts) - np.log(3)) < 1e-6  # p e^x + q e^-x = 1 at x = log(q / p)
    model = Model(np.zeros(1), np.zeros(1), 0, 0)
    assert model.surprise([], 10) == 0
    assert model.surprise([12.0, 12.0], 10) > model.surprise([12.0], 10) > model.surprise([12.0], 1000)
    x, p = calibration(np.array([20.0, 30, 25]), np.array([0.0] * 50 + [1, 2]))
    assert (np.diff(p) >= 0).all() and p[0] < 0.1 and np.interp(25, x, p) > 0.9


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in judge_toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    known = {r.doc_id: r.toxic for r in labels.collect()}
    judged = [(rows[i].predicted, y) for i, y in known.items() if i in rows and rows[i].held_out]
    assert sum(p == y for p, y in judged) >= 0.9 * len(judged)
    assert sum(p and y for p, y in judged) >= 0.6 * sum(y for _, y in judged)
    # labels that are held out, and columns beside the text, change nothing
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    again = judge_toxicity(docs.selectExpr("doc_id", "text", "'x' AS lang", "NULL AS source", "1 AS toxic"), turned).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in rows.items()}


def test_odd_rows_and_empty_tables(spark):
    rng = random.Random(3)
    texts = [*awkward(), *(prose(rng, 60) + (" vile scum vile scum" if i % 3 == 0 else "") for i in range(60))]
    docs = documents(spark, texts, ids=[None, 1, 1, *range(3, len(texts))])
    rows = [(i, 1, int(texts[i] is not None and "scum" in texts[i])) for i in range(3, len(texts))] + [(None, 1, 1), (4, None, None), (10**6, 1, 1)]
    labels = spark.createDataFrame(rows, LABELS)
    got = judge_toxicity(docs, labels).collect()
    assert len(got) == len(texts)
    toxic = {r.doc_id for r in got if r.predicted}
    assert toxic == {i for i in range(3, len(texts)) if "scum" in texts[i]}
    nothing = spark.createDataFrame([], LABELS)
    assert all(r.score == 0 for r in judge_toxicity(docs, nothing).collect())
    assert judge_toxicity(documents(spark, []), labels).collect() == []
