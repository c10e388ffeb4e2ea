"""Quality rules, token counts, line dedup and secret scans beside plain Python."""

import collections
import random
import re

import pytest
from helpers import SCHEMA, awkward, documents, prose

from dqspark.llm.lines import dedup_lines, drop_repeated_lines
from dqspark.llm.quality import RULES, fit, keep_good, quality_rules
from dqspark.llm.queries import tokenizer_file
from dqspark.llm.secrets import KINDS, scan_secrets
from dqspark.llm.tokens import encoder, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = awkward() + ["a b c a b c d " * 3, " ".join(rng.choice("abc") for _ in range(300))]
    texts += ["#x " * 60, "same line\nsame line\n\nother\nsame line"]
    rows = quality_rules(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = counted(texts[r["row"]["doc_id"]])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    rng = random.Random(2)
    good = [prose(rng, 150) for _ in range(60)]
    junk = [" ".join(w + "***" for w in prose(rng, 100).split()) for _ in range(6)]
    junk += [" ".join(w.upper() + "!!" for w in prose(rng, 100).split()) for _ in range(6)]
    junk += ["\n".join(["buy now at the shop"] * 30) for _ in range(4)]
    kept = keep_good(documents(spark, good + junk))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r.doc_id for r in kept.collect()} == set(range(len(good)))


def test_votes_are_weighed():
    n = len(RULES)
    right, noisy = "r" + "-" * (n - 1), "-r" + "-" * (n - 2)
    counts = {"-" * n: 800, "rr" + "-" * (n - 2): 100, right: 60, noisy: 2}
    model = fit(counts)
    assert model.log_odds("rr" + "-" * (n - 2)) > model.log_odds(right) > model.log_odds("-" * n)
    assert all(0 < a < 1 for a in model.accuracy().values())
    assert 0 < fit({}).bad_share < 1


def test_token_counts(spark):
    texts = awkward(3) + ["<s> </s> <unk> ▁ x", " lead  and   trail "]
    path = tokenizer_file("piece_bpe_32k.model")
    rows = token_counts(documents(spark, texts), path, limit=50).collect()
    model = encoder(path).model
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(model.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 50)


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (300, 8), (2000, 64)])
def test_spliced_chunks_give_the_same_tokens(chunk, overlap):
    e = encoder(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = [t for t in awkward(5) if t and len(t) > chunk]
    texts += ["a" * 3000, " " * 700, "\n" * 300, "é😀日" * 200, prose(rng, 900)]
    texts.append("".join(rng.choice("ab \n😀日é▁<s>") for _ in range(3000)))
    for t in texts:
        t = t[: chunk * 400]
        assert e.spliced(t, chunk, overlap).tolist() == e.ids(t)


def without_repeats(docs):
    """First windows in order of id and line stay; lines of all later ones go."""
    seen, gone = set(), {}
    for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        lines = text.split("\n")
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if any(WORD.search(x) for x in w):
                if w in seen:
                    gone.setdefault(i, set()).update((at, at + 1, at + 2))
                seen.add(w)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs if t is not None}


def test_line_dedup(spark):
    rng = random.Random(6)
    texts = awkward(7) + ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))) for _ in range(40)]
    texts += ["\n\n\n\nx\n\n\n", "\n\n\n\ny"]
    want = without_repeats(list(enumerate(texts)))
    docs = documents(spark, texts)
    rows = dedup_lines(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r["row"]["doc_id"]
        if texts[i] is None:
            assert (r.kept_text, r.n_lines, r.n_removed, r.n_spans) == (None, 0, 0, 0)
        else:
            assert r.kept_text == want[i], i
            assert r.n_lines - r.n_removed == (len(want[i].split("\n")) if r.n_removed < r.n_lines else 0)
    out = drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_line_dedup_of_repeated_and_null_ids(spark):
    text = "a b\nc d\ne f"
    rows = dedup_lines(documents(spark, [text] * 4, ids=[5, 5, None, 2])).collect()
    got = sorted((r["row"]["doc_id"] is None, r["row"]["doc_id"], r.n_removed) for r in rows)
    assert got == [(False, 2, 0), (False, 5, 3), (False, 5, 3), (True, None, 3)]


ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(spans)


def test_secret_spans(spark):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(64)) for _ in range(6)]
    bits = ['password="', "Token: ", "api_key=", "APIKEY = '", "secret", "=", ":", "abcdefgh", "x", " ", "\n", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀"]
    texts = awkward(9) + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    plain = len(texts)
    texts += ["token=secret:abcdefgh", "token=" * 200 + "abcdefghi", *(f"see {k} there" for k in keys)]
    texts.append("internationalization-of-the-understandingandmore of donaudampfschifffahrtsgesellschaften")
    docs = documents(spark, texts)
    rows = scan_secrets(docs).collect()
    assert len(rows) == len(texts)
    flagged = set()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert [(s.start, s.kind, s.stop) for s in r.base] == base_spans(t)
        assert set(r.base) <= set(r.spans) and r.spans == sorted(r.spans)
        if r.doc_id >= plain:  # those before are made of pieces of secrets
            flagged |= {t[s.start : s.stop] for s in r.spans if KINDS[s.kind] == "random"}
    assert flagged <= set(keys) and len(flagged) >= 4


def test_secrets_glued_to_names_and_paths(spark):
    rng = random.Random(15)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def key(n, alphabet):
        return "".join(rng.choice(alphabet) for _ in range(n))

    glued = [("AWS_SECRET_ACCESS_KEY=", letters + upper + "+/"), ("SIGNING_KEY=", letters + upper), ("x=", letters), ("/my-app/", letters + upper)]
    cases = [(name, key(60, alphabet)) for name, alphabet in glued for _ in range(6)]
    cases += [("AKIAABCDEFGH1234=", key(60, letters + upper)) for _ in range(6)]  # a base span in the same run
    rows = scan_secrets(documents(spark, [f"see {name}{k} there" for name, k in cases])).collect()
    seen = collections.Counter()
    for r in rows:
        name, k = cases[r.doc_id]
        start = 4 + len(name)
        seen[name] += any(s.kind == 3 and s.start >= start - len("app/") and s.stop == start + len(k) for s in r.spans)
    assert set(seen) == {name for name, _ in cases} and min(seen.values()) >= 4, seen


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules(none).count() == 0
    assert token_counts(none, tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert dedup_lines(none).count() == 0
    assert scan_secrets(none).count() == 0


def test_ids_of_texts_are_looked_up_together(monkeypatch):
    import numpy as np

    from dqspark.llm.packing import END_TOKEN, WordTokens
    from dqspark.llm.queries import tokenizer_file

    tokens = WordTokens(tokenizer_file("word_bpe_49k.json"))
    texts = ["one Two, three.", "", " \n", "four four", tokens.added[0] + " x"]
    list(tokens.encode(texts))  # learns the words
    calls, gather = [], tokens.gather
    monkeypatch.setattr(tokens, "gather", lambda found: calls.append(1) or gather(found))
    got = list(tokens.encode(texts))
    assert len(calls) == 1
    for text, ids in zip(texts, got):
        assert ids.dtype == np.uint32 and ids.tolist() == [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, END_TOKEN]


class CountingTokenizer:
    """Counts the strings that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def letters(i: int) -> str:
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_words_of_letters_are_encoded_together_and_once():
    from dqspark.llm.packing import END_TOKEN, WordTokens
    from dqspark.llm.queries import tokenizer_file

    tokens = WordTokens(tokenizer_file("word_bpe_49k.json"))
    library, tokens.tokenizer = tokens.tokenizer, CountingTokenizer(tokens.tokenizer)
    words = [letters(i) + c for i in range(1000) for c in "éñ"]
    texts = [" ".join(words), " ".join(w.capitalize() + c for w in words for c in (".", "!!", ""))]
    for text, ids in zip(texts, tokens.encode(texts)):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, END_TOKEN]
    assert tokens.tokenizer.strings < len(words) / 10


def test_memory_of_words_is_bounded_and_keeps_what_is_used(monkeypatch):
    from dqspark.llm import packing
    from dqspark.llm.queries import tokenizer_file

    monkeypatch.setattr(packing, "WORDS", 200)
    tokens = packing.WordTokens(tokenizer_file("word_bpe_49k.json"))
    library = tokens.tokenizer
    used = " ".join(letters(i) for i in range(1000, 1050))
    for k in range(1, 30):
        texts = [used, " ".join(letters(2000 * k + i) for i in range(40)) + ",", None]
        # as in pack: no more is asked of encode than there are texts
        for text, ids in zip(texts, tokens.encode([t or "" for t in texts])):
            assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, packing.END_TOKEN]
        assert len(tokens.known) <= packing.WORDS
        assert set(used.encode().split()) <= set(tokens.known)


def test_ids_of_letters_marks_and_closings():
    import random

    from dqspark.llm.packing import END_TOKEN, WordTokens
    from dqspark.llm.queries import tokenizer_file

    rng = random.Random(23)
    some = [*"aWHé×÷İıßΣςǅ한ᆨ²٣'", "W̊", "ẘ", "H̱", "'LL", "\x1c", " "]
    tokens = WordTokens(tokenizer_file("word_bpe_49k.json"))
    texts = ["".join(rng.choice(some) if rng.random() < 0.6 else rng.choice(".,!?;: \n\t") for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [f"x{chr(c)}!? {chr(c)}." for c in range(0xA1, 0x2B0)]
    for text, ids in zip(texts, tokens.encode(texts)):
        assert ids.tolist() == [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, END_TOKEN], text
