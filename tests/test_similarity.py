import itertools
import random

import pytest

import dqspark.operators.similarity as S
from dqspark.functions.text import label_similarity
from dqspark.operators.clean import clean


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b))


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(110)]
    near = [x[:i] + rng.choice("abcdé") + x[i:] for x in base[:50] for i in [rng.randint(0, len(x))]]
    return sorted({*base, *near, *(f"customer#{i:05d}" for i in range(15)), "漢字abc", "漢字abd"})


@pytest.fixture(scope="module")
def truth(labels):
    return {(a, b): ratio(a, b) for a, b in itertools.combinations(labels, 2)}


def greedy(order, truth, t):
    mapping = {}
    for v in order:
        if v not in mapping:
            for o in order:
                if o != v and o not in mapping and truth[min(v, o), max(v, o)] >= t - 1e-9:
                    mapping[o] = v
    return mapping


def test_similarity_of_any_length(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    sizes = [1, 2, 20, 61, 62, 63, 100, 124, 125]
    rows = [(text(n), text(m)) for n in sizes for m in sizes]
    df = spark.createDataFrame(rows + [("", ""), ("", "x")], "a string, b string")
    for r in df.withColumn("s", label_similarity("a", "b")).collect():
        want = 1.0 if r.a == r.b else ratio(r.a, r.b)
        assert r.s == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("block_rows", [4_000, 7])
@pytest.mark.parametrize("t", [0.6, 0.85])
def test_pairs_equal_brute_force(monkeypatch, spark, labels, truth, t, block_rows):
    monkeypatch.setattr(S, "BLOCK_ROWS", block_rows)
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [(r.a, r.b, round(r.similarity, 9)) for r in S.similar_pairs(df, t).collect()]
    want = {(a, b, round(s, 9)) for (a, b), s in truth.items() if s >= t - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("first,small", [(16, 2_000), (16, 0), (1, 0)])
def test_merge_equals_the_walk(monkeypatch, spark, labels, truth, first, small):
    monkeypatch.setattr(S, "AHEAD", first)
    monkeypatch.setattr(S, "SMALL", small)
    rng = random.Random(11)
    for t in (0.85,) if first == 1 else (0.6, 0.85):
        order = list(labels)
        rng.shuffle(order)
        df = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "label string, rank int")
        got = {r.label: r.canonical for r in S.greedy_merge(df, t).collect()}
        assert got == greedy(order, truth, t)


def test_claims_are_not_chained(spark):
    # a ~ b and b ~ c, but not a ~ c: c stays, though b went to a.
    chain = ["aaaaaaaaaa", "aaaaaaaaab", "aaaaaaaabb"]
    assert ratio(chain[0], chain[1]) >= 0.9 > ratio(chain[0], chain[2])
    df = spark.createDataFrame([(x, i) for i, x in enumerate(chain)], "label string, rank int")
    assert [tuple(r) for r in S.greedy_merge(df, 0.9).collect()] == [(chain[1], chain[0])]


def test_pairs_of_a_merge_grow_with_the_labels(spark, monkeypatch):
    """Families of similar labels, one after the other in rank: four times the members, about four times the pairs."""
    looked_at = []
    monkeypatch.setattr(S, "SMALL", 0)
    first_pairs, between = S._first_pairs, S.pairs_between
    monkeypatch.setattr(S, "_first_pairs", lambda *a: (out := first_pairs(*a), looked_at.append(out[0].count()))[0])
    monkeypatch.setattr(S, "pairs_between", lambda *a: (out := between(*a), looked_at.append(out.count()))[0])
    sums = []
    for members in (100, 400):
        rng = random.Random(members)
        rows = []
        for family in range(20):
            stem = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16))
            rows += [(stem[:13] + f"{i:03d}", family * members + i) for i in range(members)]
        looked_at.clear()
        mapping = S.greedy_merge(spark.createDataFrame(rows, "label string, rank int"), 0.8)
        assert mapping.count() == 20 * (members - 1)
        assert mapping.select("canonical").distinct().count() == 20
        sums.append(sum(looked_at))
    assert sums[0] < 20 * 100 * 20 and sums[1] <= 4.5 * sums[0]


def test_an_earlier_leader_found_later_still_claims(spark, monkeypatch):
    monkeypatch.setattr(S, "AHEAD", 1)
    monkeypatch.setattr(S, "SMALL", 0)
    rng = random.Random(8)
    order = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    order = list(dict.fromkeys(order))
    truth = {(min(a, b), max(a, b)): ratio(a, b) for a, b in itertools.combinations(order, 2)}
    df = spark.createDataFrame([(x, i) for i, x in enumerate(order)], "label string, rank int")
    assert {r.label: r.canonical for r in S.greedy_merge(df, 0.85).collect()} == greedy(order, truth, 0.85)


def test_near_duplicates_ignore_case(spark):
    rows = [("Active",), ("ACTIVE",), ("actve",), ("idle",), (None,), ("",)]
    df = spark.createDataFrame(rows, "s string")
    got = sorted(tuple(r)[1:] for r in S.near_duplicates(df, ["s"]).collect())
    assert got == [("ACTIVE", "actve", 0.909), ("Active", "actve", 0.909)]


def test_standardised_labels(spark):
    rows = [(1, "Active"), (2, "\tACTIVE\n"), (3, "active"), (4, "Actve"), (5, "Inactive"), (6, None), (7, " "), (8, "Idle")]
    df = spark.createDataFrame(rows, "id int, s string")
    out = {r.id: r.s for r in clean(df, "s", "standardize_categories", order_by="id").collect()}
    # "inactive" is within 0.857 of "active", above the default threshold; at 0.9 it stays.
    assert out == {1: "active", 2: "active", 3: "active", 4: "active", 5: "active", 6: None, 7: "", 8: "idle"}
    strict = clean(df, "s", "standardize_categories", order_by="id", fuzzy_threshold=0.9)
    assert {r.id: r.s for r in strict.collect()} == {**out, 5: "inactive"}
    again = clean(df, "s", "standardize_categories", order_by="id", fuzzy_threshold=0.8)
    twice = clean(again, "s", "standardize_categories", order_by="id", fuzzy_threshold=0.8)
    assert sorted(again.collect()) == sorted(twice.collect())


def test_order_decides_who_leads(spark):
    df = spark.createDataFrame([(2, "colour"), (2, "colour"), (1, "color")], "id int, s string")
    by_count = {r.label: r.canonical for r in S.label_mapping(df, "s").collect()}
    by_order = {r.label: r.canonical for r in S.label_mapping(df, "s", order_by="id").collect()}
    assert by_count == {"color": "colour"} and by_order == {"colour": "color"}


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        S.similar_pairs(spark.createDataFrame([("a",)], "label string"), 0.0)


@pytest.mark.parametrize("long,block_rows", [(32, 4_000), (6, 5)])
def test_long_labels_meet_over_pairs_of_characters(spark, monkeypatch, long, block_rows):
    monkeypatch.setattr(S, "LONG", long)
    monkeypatch.setattr(S, "BLOCK_ROWS", block_rows)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(4, 90))) for _ in range(25)]
    found = set(base)
    for x in base:
        for _ in range(3):
            y = list(x)
            for _ in range(rng.randint(1, max(1, len(x) // 6))):
                y[rng.randrange(len(y))] = rng.choice(["", "z", "é", "ab"])
            found.add("".join(y))
    labels = sorted(x for x in found if x)
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {(r.a, r.b) for r in S.similar_pairs(df, 0.85).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(labels, 2) if ratio(a, b) >= 0.85 - 1e-9}
    half = len(labels) // 2
    sides = [spark.createDataFrame([(x,) for x in part], "label string") for part in (labels[:half], labels[half:])]
    got = {(r.left, r.right) for r in S.pairs_between(*sides, 0.9).collect()}
    assert got == {(a, b) for a in labels[:half] for b in labels[half:] if ratio(a, b) >= 0.9 - 1e-9}


def test_keys_of_a_label_grow_with_its_length(spark):
    rng = random.Random(6)
    for n in (200, 5_000):
        one = spark.createDataFrame([("".join(rng.choice("abcdefghij ") for _ in range(n)),)], "label string")
        grams = S._grams(one, [], 0.85)
        counts = grams.groupBy("gram", "nth").count().withColumnRenamed("count", "often")
        assert S._rarest(grams, counts, [], 0.85).count() <= n
        assert S._blocks(one, [], 0.85, probe=True).count() == 0
