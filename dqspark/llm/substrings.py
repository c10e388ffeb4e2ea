"""Removal of byte strings that an earlier document holds too, by merged Burrows-Wheeler transforms.

A string of ``LENGTH`` bytes counts as repeated if it also starts in a document with a smaller id. Where
such strings may be is found first: every window of that length has an anchor, the 16 bytes in it with
the smallest hash, and equal windows have equal anchors. Windows whose anchor stands in one
document only are settled. For the others, the stretch of text that an anchor is responsible for goes to
the task of its hash, once for all its copies in a chunk of documents. There the stretches that share more than
an anchor are dealt to shards, each shard's Burrows-Wheeler transform is built, and the transforms are merged: an
interleaving of the shards, at first in any order, is refined by reading the transforms alone, up to eight symbols a
round (Holt and McMillan 2014). Once h symbols are read it is the order of all suffixes by their
first h bytes, and the round in which a border between neighbours appears tells their common prefix. After
``LENGTH`` symbols the intervals without a border are the repeated strings; each takes its smallest id.
No suffix of a shard is sorted again. What a task finds goes back to the chunks by stretch; each chunk knows
where its stretches occur, and in which documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import ship, written

LENGTH, GRAM = 50, 16
WIDTH, SIDE = LENGTH - GRAM + 1, (LENGTH - GRAM + 1) // 2
#: Bytes of documents handled as one chunk, of text per task of anchors, of stretches merged together, and
#: of a shard of them.
CHUNK, BUCKET, BATCH, SHARD = 8 << 20, 16 << 20, 1 << 16, 1 << 14
#: Bytes of documents whose anchors are looked for together, and windows at most; a position must fit into the low
#: bits of a key.
BLOCK, SLICE, LOW = 1 << 16, 1 << 22, np.uint64(24)
NO_ID = np.iinfo(np.int64).max
SEPARATOR = b"\xff"  # in no UTF-8 text
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at every position."""
    w = b.astype(np.uint64)
    for n in (1, 2, 4):
        w = w[:-n] | (w[n:] << np.uint64(8 * n))
    h = (w[:-8] * C1) ^ ((w[8:] + C1) * C2)
    h ^= h >> np.uint64(32)
    h *= C3
    return h ^ (h >> np.uint64(29))


def runs_of(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of documents that lie one after the other and end at ``ends``: hash, the first and last window
    that each is responsible for, and its place in the first one."""
    parts = []
    for at in range(0, max(0, len(b) - LENGTH + 1), SLICE):
        h = gram_hashes(b[at : at + SLICE + LENGTH - 1])
        key = (h >> LOW << LOW) | np.arange(len(h), dtype=np.uint64)
        n, width, best = len(h) - WIDTH + 1, 1, key
        while 2 * width <= WIDTH:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        rest = WIDTH - width
        owner = (np.minimum(best[:n], best[rest : rest + n]) & ((np.uint64(1) << LOW) - np.uint64(1))).astype(np.int64)
        # no window where a document ends within
        stops = np.unique(ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + n + LENGTH)])
        over = (stops[:, None] - np.arange(1, LENGTH) - at).ravel()
        owner[over[(over >= 0) & (over < n)]] = -1
        border = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
        first, last = np.flatnonzero(border[:-1]), np.flatnonzero(border[1:])
        whole = owner[first] >= 0
        first, last = first[whole], last[whole]
        parts.append((h[owner[first]], first + at, last + at, owner[first] - first))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


@lru_cache(maxsize=1)
def zstd():
    """A worker's compressor and decompressor: messages are many and small, so making these anew would cost more than using them."""
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def sealed(n: int, *parts) -> bytes:
    """A message about ``n`` things."""
    return zstd()[0].compress(b"".join([n.to_bytes(8, "little"), *parts]))


def opened(blob, *widths: int) -> list[np.ndarray]:
    """The parts of a message with so many bytes for each thing, and what follows them."""
    b = np.frombuffer(zstd()[1].decompress(blob), np.uint8)
    ends = 8 + int(b[:8].view("<i8")[0]) * np.cumsum([0, *widths])
    return [b[a:z] for a, z in zip(ends, [*ends[1:], len(b)])]


class Chunk:
    """Some documents: their ids, where each ends, and their bytes one after the other."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray):
        self.ids, self.ends, self.data = ids, ends, data
        self.begins = np.concatenate([[0], ends[:-1]])

    @classmethod
    def load(cls, blob) -> Chunk:
        ids, ends, data = opened(blob, 8, 8)
        return cls(ids.view("<i8"), ends.view("<i8"), data)

    @staticmethod
    def dump(ids: list[int], texts: list[bytes]) -> bytes:
        return sealed(len(ids), np.array(ids, "<i8"), np.cumsum([len(t) for t in texts], dtype="<i8"), *texts)

    def anchors(self, among: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """47 bits of the hash, first and last window (from the chunk's begin), place in the first window, and number of
        the document of every anchor; or of those whose bits are among given ones."""
        # some documents at a time, as much as a cache holds
        cuts = [0, *(np.flatnonzero(np.diff(self.begins // BLOCK)) + 1).tolist(), len(self.begins)]
        parts = []
        with np.errstate(over="ignore"):
            for i, j in zip(cuts, cuts[1:]):
                a, z = self.begins[i], self.ends[j - 1]
                h, first, last, inside = runs_of(self.data[a:z], self.ends[i:j] - a)
                h = short(h)
                if among is not None:
                    keep = member(h, among)
                    h, first, last, inside = h[keep], first[keep], last[keep], inside[keep]
                parts.append((h, first + a, last + a, inside.astype(np.uint8)))
        h, first, last, inside = (np.concatenate(x) for x in zip(*parts))
        return h, first, last, inside, np.searchsorted(self.ends, first, "right")


def chunks(docs: DataFrame) -> DataFrame:
    """``chunk``, ``size`` and ``docs`` (a ``Chunk``) from the documents of each partition in their order."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": [number], "size": [size], "docs": [Chunk.dump(ids, texts)]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield out()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield out()

    rows = docs.select(docs["doc_id"].cast("bigint"), docs["text"])
    return rows.mapInArrow(gathered, "chunk bigint, size bigint, docs binary")


def short(h: np.ndarray) -> np.ndarray:
    """47 bits of a hash, enough to tell anchors apart; a mistake only makes a candidate."""
    return h >> np.uint64(17)


def packed(h: np.ndarray) -> bytes:
    """Ascending numbers below 2^48 as differences, first all lowest bytes, last the highest, mostly zero."""
    steps = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(6, -1).T
    return np.cumsum(out.view("<u8").ravel().astype(np.uint64))


def numbers(h: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of hashes, in two bytes where they fit, which sort faster."""
    return (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def asked(chunk: Chunk, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket the distinct anchors of a chunk; the lowest bit tells if two of its documents have one."""
    h, *_, doc = chunk.anchors()
    if not len(h):
        return
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)).astype(np.uint64)
    one = (h[first] << np.uint64(1)) | many
    bucket = numbers(h[first], buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        yield int(bucket[part[0]]), packed(one[part])


def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every chunk in a bucket, those of its anchors that another document has too."""
    each = [unpacked(b) for b in pdf["anchors"]]
    every = np.concatenate(each)
    values, counts = np.unique(every >> np.uint64(1), return_counts=True)
    again = values[counts > 1]
    flagged = np.unique(every[(every & np.uint64(1)) == 1] >> np.uint64(1))
    again = np.union1d(again, flagged)
    out = [packed(x[member(x, again)]) for x in (e >> np.uint64(1) for e in each)]
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "again": out})


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which numbers are in a sorted array."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def planes(x: np.ndarray) -> bytes:
    """Numbers as differences, first all lowest bytes, last the highest: what hardly changes is mostly zeros."""
    return np.ascontiguousarray(np.diff(x.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(blob: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(blob.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64).astype(np.int64)


def first_alike(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each of some stretches (of 48 to 96 bytes) the number of the first one with the same text; rarely, its own."""
    wide = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=1)  # the eight bytes from every place on

    def words() -> Iterator[np.ndarray]:  # these cover the text
        for k in range(0, 48, 8):
            yield wide[begins + k]
            yield wide[begins + sizes - 8 - k]

    key = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for w in words():
            key = (key ^ w) * C2
            key ^= key >> np.uint64(29)
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(order))))
    alike = sizes[first] == sizes
    for w in words():
        alike &= w[first] == w
    return np.where(alike, first, np.arange(len(first)))


class Stretches:
    """The text around repeated anchors of a chunk: all bytes of the windows of an anchor, different ones once.

    ``begins``, ``sizes``, ``hashes``, ``inside`` (where the anchor is) and ``buckets`` of stretches, in the order of buckets; ``place``, ``who`` (an id) and
    ``of`` (which stretch) of every occurrence."""

    def __init__(self, chunk: Chunk, again: np.ndarray, buckets: int):
        h, self.place, last, inside, doc = chunk.anchors(again)
        self.who = chunk.ids[doc]
        size = last - self.place + LENGTH
        alike = first_alike(chunk.data, self.place, size) if len(h) else doc
        heads = np.flatnonzero(alike == np.arange(len(h)))
        bucket = numbers(h[heads], buckets)
        order = np.argsort(bucket, kind="stable")
        heads, self.buckets = heads[order], bucket[order]
        self.begins, self.sizes, self.hashes, self.inside = self.place[heads], size[heads], h[heads], inside[heads]
        number = np.empty(len(h), np.int64)
        number[heads] = np.arange(len(heads))
        self.of = number[alike]

    def messages(self, data: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Per bucket its stretches: sizes, 32 bits of the anchors' hashes, their places in it, the smallest and the largest id of the
        documents that hold them, and the bytes. How often they occur stays here."""
        if not len(self.begins):
            return
        low, high = np.full(len(self.begins), NO_ID), np.full(len(self.begins), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.who)
        np.maximum.at(high, self.of, self.who)
        cuts = np.flatnonzero(np.diff(self.buckets)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.begins)]):
            sizes = self.sizes[i:j]
            parts = sizes.astype(np.uint8), (self.hashes[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4"), self.inside[i:j]
            text = data[expanded(self.begins[i:j], sizes)]
            yield int(self.buckets[i]), sealed(j - i, *parts, planes(low[i:j]), planes(high[i:j] - low[i:j]), text)

    def gone(self, told: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the bytes that documents lose, by what buckets told of their stretches: runs of windows
        and the smallest id that holds them."""
        start = np.searchsorted(self.buckets, [bucket for bucket, _ in told])
        sent = [opened(blob, 8, 1, 1, 8) for _, blob in told]
        of = np.concatenate([unplaned(x[0]) + at for x, at in zip(sent, start)])
        first, last, low = (np.concatenate(x) for x in zip(*((x[1], x[2], unplaned(x[3])) for x in sent)))
        order = np.argsort(of, kind="stable")
        runs = np.bincount(of, minlength=len(self.begins))
        start = np.cumsum(runs) - runs
        n = runs[self.of]
        run = order[expanded(start[self.of], n)]
        hit = np.repeat(self.who, n) > low[run]
        run, place = run[hit], np.repeat(self.place, n)[hit]
        return place + first[run], place + last[run] + LENGTH


def ranks(keys: np.ndarray) -> np.ndarray:
    """For each number its place among the different ones."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return out


def narrow(keys: np.ndarray) -> np.ndarray:
    """Numbers below 2^32 in two bytes if they fit."""
    return keys.astype(np.uint16 if keys.max(initial=0) < 1 << 16 else np.uint32)


def by_key(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers; two bytes at a time are sorted by counting."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    if keys.itemsize > 2:
        order = order[np.argsort((keys[order] >> np.uint32(16)).astype(np.uint16), kind="stable")]
    return order


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard (of its rotations) and the order of its suffixes, by ranks of the
    first 8 symbols, then of 24, 72 and so on (of 16, 32 in large ones), until all differ."""
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    for k in (1, 2, 4):  # the 8 symbols from a place on as a number
        wide = (wide[:-k] << np.uint64(8 * k)) | wide[k:]
    rank, step = ranks(wide[:n]).astype(np.uint64), 8
    bits = np.uint64(n.bit_length())
    more = 2 if 4 * bits <= 64 else 1  # two or three ranks and a place must fit into a number
    assert 3 * bits <= 64
    while True:
        key = rank
        for k in range(1, more + 1):
            key = key << bits | np.roll(rank, -k * step)
        key = key << bits | np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        key >>= bits
        step *= more + 1
        new = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if new[-1] == n - 1 or step >= n:
            return text[order - 1], order
        rank[order] = new


def before(b: np.ndarray) -> np.ndarray:
    """For every suffix of a shard, where the suffix stands that has one more symbol in front."""
    out = np.empty(len(b), np.int32)
    out[np.argsort(b, kind="stable")] = np.arange(len(b), dtype=np.int32)
    return out


def merged(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the suffixes of shards by their first ``depth`` symbols, from the transforms alone.

    Gives the suffixes in order, as places in the transforms one after the other, and how many symbols each
    has in common with the one before (known to the symbols that a round reads at once, eight or fewer;
    ``depth`` where it is that or more).
    """
    sizes = [len(t) for t in transforms]
    offsets = np.cumsum([0, *sizes[:-1]])
    front = np.concatenate(transforms).astype(np.uint64)  # the symbols in front of a suffix, first one, then 2, 4, 8
    step = np.concatenate([before(t) + np.int32(o) for t, o in zip(transforms, offsets)])
    at = np.arange(len(front), dtype=np.int32)  # of every shard in its own order; between shards in any
    block = np.zeros(len(at), np.int32)
    common = np.full(len(at), depth, np.int16)
    common[:1] = 0
    known, read = 0, 1
    while known < depth:
        left = depth - known  # the bits of the depth below 8 are read first, by one round each
        key = narrow(front if read <= 2 else ranks(front))
        for _ in range(left // 8 if read == 8 else left % (2 * read) // read):
            own = key[at]
            order = by_key(own)
            own, block, at = own[order], block[order], step[at[order]]
            border = np.empty(len(at), bool)
            border[:1] = False
            border[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
            common[border & (common == depth)] = known
            block = np.cumsum(border, dtype=np.int32)
            known += read
        if read < 8:
            front, step, read = front[step] << np.uint64(8 * read) | front, step[step], 2 * read
    return at, common


def smallest_ids(texts: list[bytes], ids: np.ndarray, depth: int = LENGTH, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text, text after text, the smallest id of all texts that hold the same
    window; and how many windows each text has."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    whole = np.frombuffer(b"".join([x for t in texts for x in (t, SEPARATOR)]), np.uint8)
    windows = np.maximum(sizes - depth, 0)
    place = np.arange(len(whole)) - np.repeat(ends - sizes, sizes)
    is_window = place < np.repeat(windows, sizes)
    value = np.where(is_window, np.repeat(ids, sizes), NO_ID)
    numbers = (ends - 1) // shard
    cuts = [0, *ends[np.flatnonzero(np.diff(numbers))].tolist(), len(whole)]
    made = [transform(whole[a:z]) for a, z in zip(cuts, cuts[1:])]
    suffixes = np.concatenate([order + a for (_, order), a in zip(made, cuts)])
    at, common = merged([b for b, _ in made], depth)
    at = suffixes[at]
    begins = np.flatnonzero(common < depth)  # intervals of equal windows
    least = np.minimum.reduceat(value[at], begins)
    out = np.empty(len(whole), np.int64)
    out[at] = np.repeat(least, np.diff(np.append(begins, len(at))))
    return out[is_window], windows


def expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, as many as told, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def may_share(texts: list[bytes], inside: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Which different stretches may have a window in common with another one of their anchor.

    A window holds its anchor and, in front of it or behind it, ``SIDE`` bytes more. So a stretch that shares neither
    with another stretch shares no window: its anchor stands in both by chance.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    wide = np.ndarray(max(0, len(whole) - 7), "<u8", whole, strides=1)  # the eight bytes from every place on
    at = np.cumsum(sizes) - sizes + inside
    out = np.zeros(len(texts), bool)
    for own, begin in ((inside >= SIDE, -SIDE), (inside + GRAM + SIDE <= sizes, GRAM)):
        key = anchors[own].astype(np.uint64) * C1  # a mistake only makes a candidate
        for k in (0, 8, SIDE - 8):
            key = (key ^ wide[at[own] + begin + k]) * C2
            key ^= key >> np.uint64(29)
        _, which, copies = np.unique(key, return_inverse=True, return_counts=True)
        out[own] |= copies[which] > 1
    return out


def covered(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every chunk in a bucket, the runs of windows of its stretches that some of its documents lose: which stretch,
    first and last window, and the smallest id that holds them."""
    sent = [opened(x, 1, 4, 1, 8, 8) for x in pdf["stretches"]]
    known: dict[bytes, int] = {}
    each, lows, anchors = [], [], []
    for sizes, hashes, _, low, _, text in sent:
        ends, data = np.cumsum(sizes, dtype=np.int64).tolist(), text.tobytes()
        each.append(np.array([known.setdefault(data[a:z], len(known)) for a, z in zip([0, *ends[:-1]], ends)]))
        lows.append(unplaned(low))
        anchors.append(hashes.view("<u4"))
    texts, own = list(known), np.concatenate(each)
    least = np.full(len(texts), NO_ID)
    np.minimum.at(least, own, np.concatenate(lows))
    anchor = np.empty(len(texts), np.uint32)
    anchor[own] = np.concatenate(anchors)
    inside = np.empty(len(texts), np.int64)
    inside[own] = np.concatenate([x[2] for x in sent])
    # (two anchors that share 32 bits are merged together, which changes no window)
    # an anchor with a single stretch needs no merging: its copies are equal throughout
    _, which, copies = np.unique(anchor, return_inverse=True, return_counts=True)
    unlike = np.flatnonzero(copies[which] > 1)
    unlike = unlike[may_share([texts[i] for i in unlike.tolist()], inside[unlike], which[unlike])]
    # runs of windows with the same smallest id: one for a stretch that stands alone
    size = np.array([len(t) for t in texts])
    first, last, low, of = [np.zeros(len(texts), np.int64)], [size - LENGTH], [least], [np.arange(len(texts))]
    if len(unlike):
        # anchors share no window, so a few of them at a time are merged, as much as a cache holds
        unlike = unlike[np.argsort(anchor[unlike], kind="stable")]
        other = np.flatnonzero(np.diff(anchor[unlike])) + 1
        so_far = np.cumsum(size[unlike])
        cuts = other[np.flatnonzero(np.diff(so_far[other - 1] // BATCH))] if len(other) else []
        parts = []
        for part in np.split(unlike, cuts):
            values, windows = smallest_ids([texts[i] for i in part], least[part])
            text = np.repeat(part, windows)
            number = np.arange(len(values)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])]))
            end = np.append(begin[1:], len(values)) - 1
            parts.append((number[begin], number[end], values[begin], text[begin]))
        alone = np.ones(len(texts), bool)
        alone[unlike] = False
        first, last, low, of = ([x[0][alone]] for x in (first, last, low, of))
        for xs, x in zip((first, last, low, of), zip(*parts)):
            xs.extend(x)
    first, last, low, of = map(np.concatenate, (first, last, low, of))
    order = np.argsort(of, kind="stable")
    first, last, low = first[order], last[order], low[order]
    runs = np.bincount(of, minlength=len(texts))
    start = np.cumsum(runs) - runs
    rows = []
    for chunk, bucket, k, own_low, (*_, over, _) in zip(pdf["chunk"].tolist(), pdf["bucket"].tolist(), each, lows, sent):
        run, of = expanded(start[k], runs[k]), np.repeat(np.arange(len(k)), runs[k])
        hit = (own_low + unplaned(over))[of] > low[run]
        if hit.any():
            run, of = run[hit], of[hit]
            parts = (x[run].astype(np.uint8) for x in (first, last))
            rows.append((chunk, bucket, sealed(len(run), planes(of), *parts, planes(low[run]))))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "gone"])


def without(chunk: Chunk, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Per document: id, bytes, bytes removed, maximal removed runs, and the bytes kept."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    doc = np.searchsorted(chunk.ends, begins, "right")
    new = np.ones(len(begins) + 1, bool)  # runs that overlap or touch become one, within a document
    new[1:-1] = (begins[1:] > ends[:-1]) | (doc[1:] != doc[:-1])
    begins, ends, doc = begins[new[:-1]], ends[new[1:]], doc[new[:-1]]
    n = len(chunk.ids)
    spans = np.bincount(doc, minlength=n)
    sizes = np.diff(np.concatenate([[0], np.cumsum(ends - begins)])[np.concatenate([[0], np.cumsum(spans)])])
    runs = iter(zip(begins.tolist(), ends.tolist()))
    b = memoryview(chunk.data)
    for i, a, z, gone, k in zip(*(x.tolist() for x in (chunk.ids, chunk.begins, chunk.ends, sizes, spans))):
        kept, at = [], a
        for begin, end in islice(runs, k):
            kept.append(b[at:begin])
            at = end
        yield i, z - a, gone, k, b"".join([*kept, b[at:z]])


def some(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The columns of the next rows, 1,024 at a time."""
    while batch := list(islice(rows, 1024)):
        yield tuple(map(list, zip(*batch)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes).

    NULL texts count as empty. Texts shorter than ``LENGTH`` bytes lose nothing. NULL ids come after
    all others; rows with one id are no smaller than each other, so their copies stay. What a document loses is
    judged on the input. Texts may be of any length: a huge one is a chunk of its own. An empty table
    gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    table = written(chunks(docs), "chunks")
    size = table.agg(F.sum("size")).collect()[0][0] or 0
    buckets = max(1, size // BUCKET)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Row by row, so that one chunk is copied at a time."""
        for batch in batches:
            for number, blob, *lists in zip(*batch.columns):
                yield number.as_py(), Chunk.load(blob.as_buffer()), *(x.as_py() for x in lists)

    def stretches(chunk: Chunk, lists: list[bytes]) -> Stretches:
        return Stretches(chunk, np.sort(np.concatenate([unpacked(x) for x in lists])), buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in rows(batches):
            for bucket, anchors in some(asked(chunk, buckets)):
                yield pa.RecordBatch.from_pydict({"bucket": bucket, "chunk": [number] * len(bucket), "anchors": anchors})

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, lists in rows(batches):
            for bucket, found in some(stretches(chunk, lists).messages(chunk.data)) if lists else []:
                yield pa.RecordBatch.from_pydict({"bucket": bucket, "chunk": [number] * len(bucket), "stretches": found})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        for _, chunk, lists, told in rows(batches):
            gone = (np.zeros(0, np.int64),) * 2
            if told:
                gone = stretches(chunk, lists).gone([(x["bucket"], x["gone"]) for x in told])
            for ids, *rest in some(without(chunk, *gone)):
                ids = [None if i == NO_ID else i for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, rest)], names)

    anchors = table.select("chunk", "docs").mapInArrow(ask, "bucket bigint, chunk bigint, anchors binary")
    again = anchors.groupBy("bucket").applyInPandas(repeated, "chunk bigint, again binary")
    again = again.groupBy("chunk").agg(F.collect_list("again").alias("again"))
    # both uses of this join shuffle the same: Spark does it once
    shown = table.select("chunk", "docs").join(again, "chunk", "left").select("chunk", "docs", "again")
    gone = shown.mapInArrow(show, "bucket bigint, chunk bigint, stretches binary")
    gone = gone.groupBy("bucket").applyInPandas(covered, "chunk bigint, bucket bigint, gone binary")
    gone = gone.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "gone")).alias("gone"))
    last = shown.join(gone, "chunk", "left").select("chunk", "docs", "again", "gone")
    return last.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
