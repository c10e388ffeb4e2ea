"""Token alignment beside whole-text encodings whose tokens are decoded to bytes one by one."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import awkward, documents, prose
from tokenizers import Tokenizer

from dqspark.llm import spans as module
from dqspark.llm.spans import Aligner, align_tokens, byte_alphabet, portions

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def tokens(tokenizers, text):
    """Ids and bytes of both sides' tokens, or none."""
    a, b = tokenizers
    alphabet = byte_alphabet()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
    pieces = [b.id_to_piece(i) for i in ib]
    bb = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces)]
    whole = (" " + text).encode()
    return (ia, ba, ib, bb) if text and b"".join(ba) == whole and b"".join(bb) == whole else ([], [], [], [])


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def alone(tokenizers, text):
    """Groups and links of one text."""
    ia, ba, ib, bb = tokens(tokenizers, text)
    sa, sb = spans(ba), spans(bb)
    links, j = [], 0
    for i, (x, y) in enumerate(sa):
        while j and sb[j - 1][1] > x:
            j -= 1
        while j < len(sb) and sb[j][0] < y:
            if sb[j][1] > x:
                links.append((ia[i], ib[j]))
            j += 1
    told = []
    left = right = 0
    for end in sorted({e for _, e in sa} & {e for _, e in sb}):
        i, j = next(k + 1 for k in range(left, len(sa)) if sa[k][1] == end), next(k + 1 for k in range(right, len(sb)) if sb[k][1] == end)
        told.append(",".join(map(str, ia[left:i])) + "|" + ",".join(map(str, ib[right:j])))
        left, right = i, j
    return len(ia), len(ib), told, links


def brute(tokenizers, texts):
    every = [alone(tokenizers, t or "") for t in texts]
    counts = collections.Counter(p for *_, links in every for p in set(links))
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for n_a, n_b, told, links in every:
        best = sum(counts[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(told).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(told), len(links), best, sum(counts[p] for p in links), digest))
    return out


ODD = [
    "<s>a</s> <|endoftext|> x", "▁", "a ▁b", "tab\there \n\n  two   blanks ", " ", "  ", "x ", " x", "日本語 テキスト 😀😀 x y 　z",
    "été ﬁ ½", "I'll we've 'tis 12345 a_b-c", "\x00 nul a\x00b", "​  z", "a" * 300 + " b", "𐍈𐍈 ꙮ", "\r\n a\r\n", "x\u0085 y", "\x1c \x1d",
]


def test_alignment_equals_brute_force(spark, tokenizers):
    texts = [*awkward(), *ODD, *ODD[:5]]
    rows = align_tokens(documents(spark, texts), *FILES).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(tokenizers, texts)


def test_words_are_those_of_whole_texts(tokenizers):
    rng = random.Random(5)
    alphabet = "ab  \n\tzé日😀▁ '1.<>|s\x00_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += [prose(rng, 50) for _ in range(20)]
    got = list(Aligner(*FILES).batch(texts))
    for text, x in zip(texts, got):
        n_a, n_b, told, links = alone(tokenizers, text)
        assert (x.n_a, x.n_b, x.told.decode()) == (n_a, n_b, ";".join(told)), text
        assert sorted(((p >> 32), p & 0xFFFFFFFF) for p in x.pairs.tolist()) == sorted(links), text


def test_ids_and_empty_tables(spark, tokenizers):
    rng = random.Random(6)
    texts = [prose(rng, 30)] * 3 + [None]
    rows = align_tokens(documents(spark, texts, ids=[None, 7, 7, None]), *FILES).collect()
    assert sorted((r.doc_id is None, r.n_a > 0) for r in rows) == [(False, True), (False, True), (True, False), (True, True)]
    assert align_tokens(documents(spark, []), *FILES).collect() == []


def test_memory_of_words_is_bounded_and_keeps_what_is_used(tokenizers, monkeypatch):
    monkeypatch.setattr(module, "WORDS", 300)
    rng, aligner, most, long = random.Random(9), Aligner(*FILES), 0, "x" * 70
    common = [prose(rng, 1) + c for c in "abcdefghij"]
    for k in range(30):
        texts = [" ".join([*common, *(f"w{rng.randrange(10**9)}" for _ in range(10)), *([long] if k % 3 else [])]) for _ in range(6)]
        for text, x in zip(texts, aligner.batch(texts)):
            n_a, n_b, told, links = alone(tokenizers, text)
            assert (x.n_a, x.n_b, x.told.decode()) == (n_a, n_b, ";".join(told)), text
            assert sorted(((p >> 32), p & 0xFFFFFFFF) for p in x.pairs.tolist()) == sorted(links), text
        most = max(most, len(aligner.known))
        assert len(aligner.known) == len(aligner.uses) == len(aligner.words.sound) and long not in aligner.known
        assert k == 0 or all(w in aligner.known for w in common)
    assert most <= 300 + 80


def test_texts_are_taken_by_their_length(monkeypatch):
    monkeypatch.setattr(module, "TOGETHER", 100)
    rng = random.Random(10)
    texts = [None if rng.random() < 0.1 else "x" * rng.choice([0, 5, 40, 300]) for _ in range(200)]
    got = list(portions(pa.array(texts, pa.string())))
    assert [t for p in got for t in p] == [t or "" for t in texts]
    assert all(sum(map(len, p[:-1])) < 100 for p in got) and len(got) > 40


def test_long_texts_keep_their_ids(spark):
    texts = [" ".join(["the"] * (150_000 + i)) for i in range(12)]
    rows = align_tokens(documents(spark, texts), *FILES).collect()
    assert sorted((r.doc_id, r.n_a) for r in rows) == [(i, 150_000 + i) for i in range(12)]
