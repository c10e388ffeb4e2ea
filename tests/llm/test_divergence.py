"""The audit of sources beside a brute-force version that keeps every count of every term."""

import collections
import random
import re

from helpers import awkward, prose

from dqspark.llm.divergence import audit_sources

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n bigint, p int, value double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, a, s, "x", 1, 2, 0.5) for i, (t, a, s) in enumerate(rows)], SCHEMA).repartition(4)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups, langs, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        lang = lang or ""
        groups[lang, source or ""].update(found)
        langs[lang].update(found)
        held[lang].update(set(found))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 10]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p, q = shares(own), shares(langs[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                r = shares(counts)
                pairs.append((-sum(f(p[t], r[t]) for t in kept), other.encode()))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(items)[:most], 1)]
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted(map(tuple, audit_sources(table(spark, rows)).collect()), key=repr)


def test_audit_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(t, rng.choice(["en", None, ""]), rng.choice(["a", "é", None, "Z"])) for t in awkward() * 3]
    for _ in range(300):
        source = rng.choice(["a", "b", "c", "a_very_hot_one", None])
        words = prose(rng, rng.randrange(0, 60), vocabulary=60 if source == "b" else 25)
        rows.append((words.upper() if rng.random() < 0.2 else words + " Été ÜBER été", rng.choice(["en", "de"]), source))
    assert got(spark, rows) == brute(rows)


def test_ties_and_texts_without_terms(spark):
    # a language without kept terms has pairs of value 0; equal values are ranked by the bytes of the item
    rows = [("123 456", "xx", s) for s in ("b", "a", "é", "Z")] + [(None, None, None)]
    assert got(spark, rows) == brute(rows)
    tied = [(" ".join(f"t{c}" for c in "hgfedcbaijklmnop"), "en", "one")] * 12 + [("other words", "en", "two")] * 12
    assert got(spark, tied) == brute(tied)


def test_empty_table(spark):
    assert audit_sources(table(spark, [])).collect() == []


def test_long_texts_come_in_parts_and_count_as_one_document(spark, monkeypatch):
    import dqspark.llm.divergence as D

    monkeypatch.setattr(D, "CHUNK", 40)
    text = ("Alpha beta beta GAMMA delta " * 9).encode()
    parts = list(D.terms(text))
    assert len(parts) > 3 and [t for p in parts for t in p] == text.lower().split()
