"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet.

Tokenizer A gives character offsets, tokenizer B spans in a protocol message. Both are coarse cuts: a token that ends
within a character has the span of the whole character, or none. Between two cuts the decoded bytes of the
tokens tell where each ends.

A text falls into words at blanks which no token of either side can cross: A's pattern always splits there, and B
has no piece in which the character before stands beside its mark for a blank. So words are aligned once each, and a
text's alignment is that of its words, one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import ship, written
from dqspark.llm.substrings import opened, planes, sealed, unplaned

MARK = "▁"
#: Words a worker remembers, and the longest one remembered; different pairs of documents that go
#: into one chunk, characters of documents that are split into words together, words that are encoded as one text, and
#: words that are aligned in one go.
WORDS, LONG, CHUNK, TOGETHER, LINE, BLOCK = 1 << 17, 64, 1 << 20, 1 << 20, 256, 8192


@dataclass
class Aligned:
    """The tokens of some texts and where they meet. ``pairs`` holds the overlapping pairs of tokens of all texts, A's
    id in the upper half, those of text i from ``bounds[i]`` to ``bounds[i + 1]``; ``told`` are the bytes of their groups in
    writing, each with what separates it from the next, of text i from ``stops[i]`` to ``stops[i + 1]``; ``sound`` says
    whether both sides give back the text's bytes."""

    sound: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    bounds: np.ndarray
    pairs: np.ndarray
    stops: np.ndarray
    told: np.ndarray

    def at(self, texts: np.ndarray) -> Aligned:
        """The alignments of some of the texts, one after the other."""
        own = [x[texts] for x in (self.sound, self.n_a, self.n_b, self.n_groups)]
        return Aligned(*own, *ragged(self.bounds, self.pairs, texts), *ragged(self.stops, self.told, texts))


@dataclass
class Document:
    """As above for one text."""

    n_a: int
    n_b: int
    n_groups: int
    pairs: np.ndarray
    told: bytes


def ragged(bounds: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some runs of values, that lie from one bound to the next, and their bounds among each other."""
    begins, ends = bounds[at], np.concatenate([[0], np.cumsum(bounds[at + 1] - bounds[at])])
    sizes = np.diff(ends)
    return ends, values[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]


NOTHING = Document(0, 0, 0, np.zeros(0, np.int64), b"")


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others
    for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def token_ends(coarse: np.ndarray, whole: np.ndarray, lengths: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes; the tokens of a text end before ``stops``, and its last one where the text does.

    ``whole``: the spans show that the token ends where a character does, so its span's end is a cut. From
    one cut to the next the other tokens end where their decoded bytes do.
    """
    coarse, whole = coarse.copy(), whole.copy()
    some = np.diff(stops, prepend=0) > 0
    coarse[stops[some] - 1], whole[stops[some] - 1] = ends[some], True
    if whole.all():
        return coarse
    sums = np.concatenate([[0], np.cumsum(lengths)])
    cut = np.maximum.accumulate(np.where(whole, np.arange(1, len(whole) + 1), 0))
    return np.concatenate([[0], coarse])[cut] + sums[1:] - sums[cut]


class Aligner:
    """Two tokenizers, the bytes of their tokens, and the words they have aligned."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        # characters that stand before a mark in some piece: no cut after those
        before = {p[i] for p in names for i in range(len(p) - 1) if p[i + 1] == MARK}
        last = f"[^\\s{re.escape(''.join(sorted(before | {MARK})))}]"
        self.cut = re.compile(f"(?<={last}) (?=.)", re.DOTALL)
        # words that may stand before others: no token crosses the blank after them
        self.regular = re.compile(f"[^{MARK}]*(?<={last})", re.DOTALL)
        self.a_size, self.b_size = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        # ids in writing, with what follows them: inside a group, and at its end
        signs = ((self.a_bytes, b","), (self.a_bytes, b"|"), (self.b_bytes, b","), (self.b_bytes, b";"))
        self.written = np.array([b"%d" % i + sign for own, sign in signs for i in range(len(own))], object)
        self.written_size = np.array([len(x) for x in self.written])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        empty = [np.zeros(0, t) for t in (bool, int, int, int)]
        self.words = Aligned(*empty, np.zeros(1, int), np.zeros(0, np.int64), np.zeros(1, int), np.zeros(0, np.uint8))
        self.uses = np.zeros(0, np.int32)

    def spare(self) -> None:
        """Keep the half of the memory that the most batches of texts held; older batches count less each time."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: WORDS // 2])
        words = list(self.known)
        self.known = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.words, self.uses = self.words.at(keep), self.uses[keep] // 2

    def lines(self, texts: list[str]) -> list[int]:
        """Where texts that are encoded together begin, and the number of texts."""
        out, open_ = [], 0
        for i, t in enumerate(texts):
            if not open_:
                out.append(i)
            open_ = (open_ + 1) % LINE if self.regular.fullmatch(t) else 0
        return [*out, len(texts)]

    def align(self, texts: list[str], alone: bool = False) -> Aligned:
        """The alignment of non-empty texts, all in one go: they lie one after the other, each with its blank before it.
        As many as tokens cannot cross are encoded as one, unless ``alone``."""
        begins = range(len(texts) + 1) if alone else self.lines(texts)
        lines = [" ".join(texts[i:j]) if j - i > 1 else texts[i] for i, j in zip(begins, begins[1:])]
        spaced = [" " + t for t in lines]
        own = [t.encode() for t in spaced]
        a = [self.a.encode(t, add_special_tokens=False) for t in spaced]  # one by one: threads would each keep memory
        b = [x.pieces for x in self.b.encode(lines, return_type="proto", num_threads=1)]
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a = np.fromiter(chain.from_iterable(x.ids for x in a), np.int64, n_a.sum())
        ids_b, begin, end = np.array([v for x in b for p in x for v in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3).T
        sound = self.gives_back(own, ids_a, n_a, ids_b, n_b)
        if not alone and not sound.all():
            return self.align(texts, alone=True)
        sizes = np.array([len(x) for x in own])
        ends = np.cumsum(sizes)

        # A's spans are characters of its text
        code = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
        chars = np.array([len(t) for t in spaced])
        spans = np.array(list(chain.from_iterable(x.offsets for x in a)), np.int64) + np.repeat(np.cumsum(chars) - chars, n_a)[:, None]
        # a token that ends within a character has a successor whose span begins before its own ends
        e_a = token_ends(at[spans[:, 1]], np.append(spans[1:, 0] >= spans[:-1, 1], True), self.a_size[ids_a], np.cumsum(n_a), ends)
        # B's are bytes of its text, without the blank before it; bytes of a character but the last have no width
        first = np.repeat(ends - sizes + 1, n_b)
        e_b = token_ends(end + first, end > begin, self.b_size[ids_b], np.cumsum(n_b), ends)
        if not alone:  # from lines to texts
            ends = at[np.cumsum([len(t) + 1 for t in texts])]
            n_a, n_b = (np.diff(np.searchsorted(e, ends, "right"), prepend=0) for e in (e_a, e_b))
            sound = np.ones(len(texts), bool)

        if not sound.all():  # what is not given back has no places that could be compared
            whole = np.repeat(sound, n_a), np.repeat(sound, n_b)
            ids_a, e_a, ids_b, e_b = ids_a[whole[0]], e_a[whole[0]], ids_b[whole[1]], e_b[whole[1]]
            n_a, n_b = n_a * sound, n_b * sound
        common = np.intersect1d(e_a, e_b, assume_unique=True)
        cuts = np.union1d(e_a, e_b)  # between two of them lies one token of each side
        pairs = (ids_a[np.searchsorted(e_a, cuts)] << 32) | ids_b[np.searchsorted(e_b, cuts)]
        bounds = np.concatenate([[0], np.searchsorted(cuts, ends, "right")])
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(common, ends, "right")]))

        group_a, group_b = np.searchsorted(common, e_a), np.searchsorted(common, e_b)
        place_a = np.arange(len(e_a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(e_b)) + np.searchsorted(group_a, group_b, "right")
        sign = np.zeros(len(e_a) + len(e_b), np.int64)
        k_a, k_b = len(self.a_bytes), len(self.b_bytes)
        sign[place_a] = ids_a + k_a * np.isin(e_a, common, assume_unique=True)
        sign[place_b] = ids_b + 2 * k_a + k_b * np.isin(e_b, common, assume_unique=True)
        told = np.frombuffer(b"".join(self.written[sign].tolist()), np.uint8)  # the last sign of a text ends a group
        stops = np.concatenate([[0], np.cumsum(self.written_size[sign])])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        return Aligned(sound, n_a, n_b, n_groups, bounds, pairs, stops, told)

    def gives_back(self, own: list[bytes], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """For each text whether the tokens' bytes of both sides are the text's bytes."""
        sound = np.ones(len(own), bool)
        for names, ids, n in ((self.a_bytes, ids_a, n_a), (self.b_bytes, ids_b, n_b)):
            parts = [names[i] for i in ids.tolist()]
            stops = np.cumsum(n).tolist()
            sound &= [b"".join(parts[i:j]) == whole for whole, i, j in zip(own, [0, *stops], stops)]
        return sound

    def learn(self, words: Iterable[str]) -> None:
        """Align words that are not known yet."""
        new = [w for w in dict.fromkeys(words) if w not in self.known and len(w) <= LONG]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        blocks = [self.words, *(self.align(new[at : at + BLOCK]) for at in range(0, len(new), BLOCK))]
        if len(blocks) > 1:
            self.words = joined(blocks)
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])

    def batch(self, texts: list[str]) -> Iterator[Document]:
        """The alignment of each text; a text that a side does not give back has no tokens. Words of the texts are held
        besides those remembered."""
        if len(self.known) > WORDS:
            self.spare()
        split = [self.cut.split(t) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        self.learn(words)
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))  # -1: too long
        del words
        self.uses[np.unique(number[number >= 0])] += 1
        begin = 0
        for text, parts in zip(texts, split):
            if not parts:
                yield NOTHING
                continue
            source, at = self.words, number[begin : begin + len(parts)]
            begin += len(parts)
            if at.min() < 0:
                source = self.align(parts)  # with the long words in their places
                at = np.arange(len(parts))
            if not source.sound[at].all():  # decided on the whole text
                source, at = self.align([text]), np.array([0])
                if not source.sound[0]:
                    yield NOTHING
                    continue
            _, pairs = ragged(source.bounds, source.pairs, at)
            counts = (int(x[at].sum()) for x in (source.n_a, source.n_b, source.n_groups))
            told = b"".join(ragged(source.stops, source.told, at[k : k + BLOCK])[1].tobytes() for k in range(0, len(at), BLOCK))
            yield Document(*counts, pairs, told[:-1])


def joined(blocks: list[Aligned]) -> Aligned:
    """The alignments of several lists of texts as that of one list."""
    def bounds(name: str, values: str) -> np.ndarray:
        before = np.cumsum([0] + [len(getattr(x, values)) for x in blocks[:-1]])
        return np.concatenate([[0], *(getattr(x, name)[1:] + n for x, n in zip(blocks, before))])

    def all_of(name: str) -> np.ndarray:
        return np.concatenate([getattr(x, name) for x in blocks])

    arrays = [all_of(k) for k in ("sound", "n_a", "n_b", "n_groups")]
    return Aligned(*arrays, bounds("bounds", "pairs"), all_of("pairs"), bounds("stops", "told"), all_of("told"))


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in their order, some characters of them at a time."""
    out, size = [], 0
    for t in texts:
        out.append(t.as_py() or "")
        size += len(out[-1])
        if size >= TOGETHER:
            yield out
            out, size = [], 0
    if out:
        yield out


@lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One aligner per pair of files and worker."""
    return Aligner(byte_level, pieces)


def aligned_chunks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Rows of ``chunk``: some neighbouring documents with their ids, counts and digests, and per document its
    different pairs with how often each occurs (``pairs``, all one after the other and compressed: plain arrays of a million
    numbers take an executor hundreds of MB to sort and hand on; ``sizes`` how many each has)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "told", "sizes", "pairs"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array([first + number], pa.int64()), pa.array([list(columns[0])], pa.list_(id_type))]
            arrays += [pa.array([list(columns[k])], pa.list_(pa.int64())) for k in range(1, 5)]
            arrays.append(pa.array([list(columns[5])], pa.list_(pa.string())))
            arrays.append(pa.array([[len(p) for p in columns[6]]], pa.list_(pa.int64())))
            pairs, times = (np.concatenate(columns[k]) for k in (6, 7))
            arrays.append(pa.array([sealed(len(pairs), planes(pairs), times.astype("<u4"))], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_type = batch.column(0).type
            ids = iter(batch.column(0).to_pylist())
            for texts in portions(batch.column(1)):
                for doc_id, x in zip(list(islice(ids, len(texts))), aligner(byte_level, pieces).batch(texts)):
                    pairs, times = np.unique(x.pairs, return_counts=True)
                    told = hashlib.sha256(x.told).hexdigest() if x.n_a else ""
                    rows.append((doc_id, x.n_a, x.n_b, x.n_groups, len(x.pairs), told, pairs, times))
                    held += 32 + len(pairs)
                    if held >= CHUNK:
                        yield out()
                        rows.clear()
                        held, number = 0, number + 1
        if rows:
            yield out()

    ship(docs.sparkSession)
    schema = (
        f"chunk bigint, doc_id array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>,"
        " told array<string>, sizes array<bigint>, pairs binary"
    )
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(encode, schema)


def pairs_of(blob) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a chunk's documents, and how often each occurs in its document."""
    pairs, times, _ = opened(blob, 8, 4)
    return unplaned(pairs), times.view("<u4").astype(np.int64)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``pair``, ``n`` of every different pair of a chunk: in how many of its documents it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs in zip(batch.column(0), batch.column(1)):
                own, n = np.unique(pairs_of(pairs.as_buffer())[0], return_counts=True)
                columns = [pa.array(np.full(len(own), chunk.as_py())), pa.array(own), pa.array(n)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], ["chunk", "pair", "n"])

    return chunks.select("chunk", "pairs").mapInArrow(count, "chunk bigint, pair bigint, n bigint")


def align_tokens(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Per document ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``byte_level`` is a byte-level BPE file for tokenizers, ``pieces`` a SentencePiece BPE model with identity
    normalisation; every executor can open both. Groups lie between bytes where tokens of both sides end; links are the
    pairs of tokens that share bytes; a pair of ids counts as often as documents hold it linked. NULL and empty texts, and such as a
    side does not give back byte by byte, have no tokens: zeros and an empty digest. Texts of any length are aligned whole; a worker holds
    one chunk of documents and the longest run without a blank. Rows with NULL or repeated ids are documents each; an
    empty table gives an empty one; other columns are not read.

    Pairs are counted chunk by chunk, and each chunk gets back the counts of its own pairs: what is shuffled are
    different pairs per chunk, neither links nor documents.
    """
    kind = docs.schema["doc_id"].dataType
    chunks = written(aligned_chunks(docs, byte_level, pieces), "chunks")
    by_chunk = written(pair_counts(chunks), "chunk-pairs")
    counts = by_chunk.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = by_chunk.select("chunk", "pair").join(counts, "pair").select("chunk", "pair", "n", "best")

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        known, n = right["pair"].to_numpy()[order], right["n"].to_numpy()[order]
        is_best = right["best"].to_numpy()[order].astype(bool)
        (row,) = [left.slice(i, 1) for i in range(len(left))]
        flat = {c: row[c].combine_chunks().flatten() for c in row.column_names if c not in ("chunk", "pairs")}
        sizes, (pairs, times) = flat["sizes"].to_numpy(), pairs_of(row["pairs"][0].as_buffer())
        at = np.searchsorted(known, pairs)
        ends = np.cumsum(sizes)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * is_best[at], times * n[at])]
        n_best, count_sum = (s[ends] - s[ends - sizes] for s in sums)
        columns = [flat["doc_id"], *(flat[c] for c in names[1:5]), pa.array(n_best), pa.array(count_sum), flat["told"]]
        return pa.Table.from_arrays(columns, names)

    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(judge, schema)
