"""Packing token streams into sequences by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of tokens. It is cut into windows of at
most ``LENGTH`` tokens; a cut at the end of a document costs nothing, one at the end of a
sentence little, any other more, and a window costs the padding it needs. Cut places are the ends of
documents and sentences, and every ``STRIDE`` tokens where those lie far apart. The cheapest cuts
are found from left to right: with padding linear in the length, the best earlier cut is
the minimum of a sliding window, kept in a monotone queue.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dqspark.llm.common import ship

LENGTH, END_TOKEN = 4096, 2
#: What a cut costs, in tokens of padding: within a document at a sentence's end, and elsewhere.
SENTENCE_CUT, OTHER_CUT = 16, 128
#: Tokens between cut places where there is no better one; tokens of a round; words remembered; bytes of
#: texts that are split together; words that are encoded together; words of a line that is encoded.
STRIDE, ROUND, WORDS, BYTES, TOGETHER, LINE = 256, 1 << 18, 1_000_000, 1 << 23, 1 << 14, 64
CLOSING = ".,!?;:*$&#%"
#: After these, closing punctuation is a part of its own: ASCII letters and digits, and the letters from U+00C0 to
#: U+024F but the one that is lower-cased to a letter and a mark.
LETTER_LAST = "[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ]$"
FREE = [1 << k for k in range(LENGTH.bit_length())]  # windows of these lengths are not padded


class WordTokens:
    """A tokenizer whose tokens never cross white space, with a memory of words it has seen.

    The normaliser and the splitting pattern of the file drop white space, so the tokens of
    a text are those of its words one after the other. Texts that hold the string of an added token
    are given to the tokenizer whole. The memory keeps the words that most batches of texts held.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What each added token begins with in any case.
        self.heads = {"".join(takewhile(lambda c: c.lower() == c.upper(), a)) for a in self.added}
        vocab = self.tokenizer.get_vocab()
        ends = [i for t, i in vocab.items() if t.removesuffix("</w>") and set(t.removesuffix("</w>")) <= set(".!?\"')")]
        ends = [i for i in ends if set(".!?") & set(self.tokenizer.id_to_token(i))]
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[ends] = True
        last = [t for t in vocab if t.endswith("</w>")]
        self.is_last = np.zeros(len(self.is_end), bool)
        self.is_last[[vocab[t] for t in last]] = True
        self.marked = sum(len(t) == 5 for t in last) == 256  # whatever its last byte, a word ends in such a token
        self.known: dict[bytes, int] = {}  # their numbers are 0, 1, 2, ... in this order
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 12, np.int64)  # where each word's ids begin; its successor's is their end
        self.uses = np.zeros(1 << 12, np.int32)  # batches that held a word, the older ones counting less
        self.store([b" ", b""], np.array([END_TOKEN], np.uint32), [1, 0])  # a space, which no word holds, is the end token

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of stems or closings. Each different one is looked up once; the new ones are encoded."""
        words = words.dictionary_encode()
        if not len(words):
            return np.zeros(0, np.int64)
        different = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.binary()))
        different = pc.binary_join(different, b"\n")[0].as_py().split(b"\n")  # no word holds a line end
        known = self.known
        found = np.fromiter(map(known.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(found < 0).tolist()
        for i in range(0, len(new), TOGETHER):  # what the tokenizer returns is many times the size of the ids
            self.encode_stems([different[j].decode() for j in new[i : i + TOGETHER]])
        found[new] = [known[different[j]] for j in new]
        self.uses[found] += 1
        return found[words.indices.to_numpy()]

    def encode_stems(self, stems: list[str]) -> None:
        """Words of letters alone have one token that ends a word each, so many of them are encoded as one line."""
        plain = [x for x in stems if self.marked and x.isalpha()]
        if plain:
            lines = [" ".join(plain[i : i + LINE]) for i in range(0, len(plain), LINE)]
            ids = self.ids_of(lines)[0]
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) == len(plain):
                self.store([x.encode() for x in plain], ids, np.diff(ends, prepend=0))
            else:  # a letter that the splitting pattern does not take for one
                plain = []
        single = [x for x in stems if not x.isalpha()] if plain else stems
        if single:
            self.store([x.encode() for x in single], *self.ids_of(single))

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), list(map(len, lists))

    def store(self, words: list[bytes], ids: np.ndarray, sizes) -> None:
        n, used = len(self.known), int(self.bounds[len(self.known)])
        while n + len(words) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(words)] = used + np.cumsum(sizes)
        self.uses[n : n + len(words)] = 0
        self.known.update(zip(words, range(n, n + len(words))))

    def forget(self) -> None:
        """Keep the more used half of a full memory, the most used first; what was counted so far counts half from now on."""
        uses = self.uses[: len(self.known)]
        keep = np.concatenate([[0, 1], 2 + np.argsort(-uses[2:], kind="stable")[: WORDS // 2]])
        words, uses, (ids, sizes) = list(self.known), uses[keep] // 2, self.gather(keep)
        self.known.clear()
        self.store([words[i] for i in keep.tolist()], ids, sizes)
        self.uses[: len(keep)] = uses

    def gather(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after the other, and how many each has."""
        starts = self.bounds[found]
        sizes = self.bounds[found + 1] - starts
        return slices(self.ids, starts, sizes), sizes

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, then the end token. Each different word of all of them is looked up once."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return
        # added tokens are found before a text is lower-cased; a word is looked up in lower case, so one that
        # becomes such a token only then must not be looked up
        whole = np.zeros(len(texts), bool)
        for head in self.heads:
            whole |= pc.match_substring(texts, head).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole).tolist():
            low = texts[i].as_py().lower()
            whole[i] = any(a in low for a in self.added)
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts) if whole.any() else texts)
        words = split.flatten().dictionary_encode()
        own, sizes = self.gather(np.append(np.stack([self.numbers(x) for x in parts(words.dictionary)], axis=1), 0))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1:2]  # of the ids of each different word; the end token is the last
        sizes = np.append(sizes[:-1].reshape(-1, 2).sum(axis=1), 1)
        ends = split.offsets.to_numpy()[1:]
        words = np.insert(words.indices.to_numpy(), ends, len(sizes) - 1)
        sizes = sizes[words]
        ids = slices(own, starts[words], sizes)
        ends = np.cumsum(sizes)[ends + np.arange(len(ends))].tolist()
        if len(self.known) > WORDS:  # before the ids are handed out: a caller need not ask for more than it has texts
            self.forget()
        for i, (start, end) in enumerate(zip([0, *ends], ends)):
            if whole[i]:
                yield np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, END_TOKEN], np.uint32)
            else:
                yield ids[start:end]


def slices(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array one after the other."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


def parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The stem and the closing punctuation of each word.

    Closing punctuation after a letter or digit is a part of its own in the splitting pattern, and ASCII
    letters are lower-cased. Marks compose with capitals and small letters differently, so words that may
    hold some stay as they are.
    """
    cut = pc.ascii_rtrim(words, CLOSING)
    size, left = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, cut))
    apart = np.flatnonzero(left < size)
    apart = apart[pc.match_substring_regex(cut.take(apart), LETTER_LAST).to_numpy(zero_copy_only=False)]
    closes = np.zeros(len(words), bool)
    closes[apart] = True
    stems = pc.if_else(closes, cut, words)
    stems = pc.if_else(pc.or_(pc.string_is_ascii(stems), pc.utf8_is_alpha(stems)), pc.ascii_lower(stems), stems)
    sizes = np.where(closes, size - left, 0)
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)] + left
    text = slices(np.frombuffer(words.buffers()[2] or b"", np.uint8), begin, sizes)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return stems, pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(text))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One tokenizer per file and worker."""
    return WordTokens(path)


def cut_places(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places at which the stream may be cut, and what a cut there costs.

    ``ends``: places at which documents end. At the end of the last round every place of the last
    window is one, so that what remains may be cut into windows without padding.
    """
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    places = np.unique(np.concatenate([[0], np.flatnonzero(is_end[ids]) + 1, ends, [n]]))
    gaps = np.flatnonzero(np.diff(places) > STRIDE)
    for g in gaps.tolist():
        cost[places[g] + STRIDE : places[g + 1] : STRIDE] = OTHER_CUT
    if last:
        cost[max(1, n - LENGTH) :] = OTHER_CUT
    cost[places] = SENTENCE_CUT
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(places: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest cuts: the places (first and last included) at which windows begin and end."""
    n = len(places)
    at, pay = places.tolist(), cost.tolist()
    ends, begins = [], []  # windows that are not padded, by their ends
    for size in FREE:
        if size <= length:
            hit = np.minimum(np.searchsorted(places, places - size), n - 1)
            end = np.flatnonzero(places[hit] == places - size)
            ends.append(end)
            begins.append(hit[end])
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    upto = np.cumsum(np.bincount(ends, minlength=n)).tolist()
    begins = begins[np.argsort(ends, kind="stable")].tolist()
    best, come = [0] * n, [0] * n
    # cost so far plus place: its minimum over the window is the best cut before
    queue, keys, head, first, done = [0], [0], 0, 0, 0
    for j in range(1, n):
        p = at[j]
        far = p - length
        while first < far:
            head += 1
            first = at[queue[head]]
        prev, low = queue[head], keys[head] - far
        if done < upto[j]:
            for i in begins[done : upto[j]]:
                if best[i] < low:
                    low, prev = best[i], i
            done = upto[j]
        low += pay[j]
        best[j], come[j] = low, prev
        low += p
        while len(keys) > head and keys[-1] >= low:
            keys.pop()
            queue.pop()
        if len(keys) == head:
            first = p
        keys.append(low)
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(come[out[-1]])
    return [at[j] for j in reversed(out)]


class Packer:
    """Packs one partition's documents as they come; holds one round of tokens."""

    def __init__(self, tokens: WordTokens, first_sequence: int):
        self.tokens, self.sequence = tokens, first_sequence
        self.open: list[list] = []  # document's index, its ids, how many of them are packed
        self.size = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        self.open.append([doc, ids, 0])
        self.size += len(ids)
        if self.size >= ROUND:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces: document's index, start, length, checksum, its tokens, sequence, offset there."""
        if not self.size:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.open])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.open])
        cuts = best_cuts(*cut_places(stream, ends, self.tokens.is_end, last))
        if not last:  # the last windows are cut again, with what follows
            cuts = [c for c in cuts if c <= len(stream) - 2 * LENGTH] or [0]
        self.size -= cuts[-1]
        k = 0
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                doc, ids, done = self.open[k]
                n = min(b - at, len(ids) - done)
                crc = zlib.crc32(ids[done : done + n].astype("<u4", copy=False))
                yield doc, done, n, crc, len(ids), self.sequence, at - a
                at += n
                self.open[k][2] += n
                k += self.open[k][2] == len(ids)
            self.sequence += 1
        del self.open[:k]


def together(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts, of ``BYTES`` bytes in all unless one alone is longer."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BYTES, side="right")))
        yield texts.slice(start, end - start)
        start = end


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    ``tokenizer`` is a file that every executor can open. Every partition of the input is a stream
    of its own, in its order, so nothing is shuffled. NULL and empty texts are one end token. Repeated
    rows are packed each; NULL ids are passed on; an empty table gives no piece; other columns
    are not read. A worker holds one round of tokens, or the longest document's.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles; looking for them would walk through all remembered words
        try:
            yield from streamed(batches)
        finally:
            gc.enable()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        packer = Packer(tokens, TaskContext.get().partitionId() << 40)
        ids, rows, before = [], [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array([ids[d] for d in columns[0]], id_type)]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, NAMES)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for some in together(batch.column(1)):
                for doc_id, own in zip(batch.column(0).slice(len(ids) - before, len(some)).to_pylist(), tokens.encode(some)):
                    ids.append(doc_id)
                    rows.extend(packer.add(len(ids) - 1, own))
            before += len(batch)
            if rows:
                yield out()
                rows.clear()
        rows.extend(packer.pack(last=True))
        if rows:
            yield out()

    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in NAMES[1:])
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(packed, schema)
