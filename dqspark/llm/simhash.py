"""Near-duplicates by SimHash, with candidates from the pigeonring principle.

The 64 bits of a fingerprint are cut into ``SEGMENTS`` consecutive segments that form a ring. If two
fingerprints differ in at most ``LIMIT`` bits, then from some segment on every chain of l
consecutive segments differs in at most l * LIMIT / SEGMENTS bits. With five segments and four bits
the budgets are 0, 1, 2, 3, 4: the first segment is equal, the second differs in one bit at
most. Both together are the join key (one side lists the 14 forms of the second
segment), the longer chains prune, and the full Hamming distance decides.

Copies share a fingerprint and enter the search as one; no pair within a group of copies is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import row_keys, ship, written

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Offset and width of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shingles hashed before their bits are added up.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 for one without words."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist())
        h = np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``doc_id``, ``fp`` of every row."""
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), fp], ["k1", "k2", "doc_id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"k1 bigint, k2 bigint, doc_id {kind}, fp bigint")


def segment(fp: str, i: int) -> str:
    offset, width = SEGMENTS[i % len(SEGMENTS)]
    return f"(shiftrightunsigned({fp}, {offset}) & {(1 << width) - 1}L)"


def chain(a: str, b: str, start: int, length: int) -> str:
    """The bits of a chain of segments in which two fingerprints differ."""
    mask = 0
    for i in range(start, start + length):
        offset, width = SEGMENTS[i % len(SEGMENTS)]
        mask |= ((1 << width) - 1) << offset
    mask -= (mask >> 63) << 64
    return f"bit_count(({a} ^ {b}) & {mask}L)" if mask != -(1 << 63) else f"bit_count({a} ^ {b})"


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of different fingerprints that differ in at most ``LIMIT`` bits, each once."""
    m = len(SEGMENTS)
    exact, forms = [], []
    for i in range(m):
        first, second = segment("fp", i), segment("fp", i + 1)
        head = f"shiftleft({i}L, 26) | shiftleft({first}, 13)"
        exact.append(f"{head} | {second}")
        flips = [0, *(1 << bit for bit in range(SEGMENTS[(i + 1) % m][1]))]
        forms += [f"{head} | ({second} ^ {flip}L)" for flip in flips]
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*map(F.expr, exact))).alias("key"))
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.array(*map(F.expr, forms))).alias("key"))
    start = "shiftright(key, 26)"
    budgets = []
    for i in range(m):
        fits = [f"{chain('a', 'b', i, n)} <= {n * LIMIT // m}" for n in range(2, m)]
        budgets.append(f"({start} = {i} AND {' AND '.join(fits)})")
    near = probe.join(index, "key").where("a < b").where(" OR ".join(budgets)).where(f"bit_count(a ^ b) <= {LIMIT}")
    return near.select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of all nodes in pairs.

    Every round each node moves to the smallest among itself and its neighbours, and the links follow
    their ends: those within a node vanish, equal ones become one, so a dense group shrinks to a point in a
    round or two. Moves and links are written each round; no round depends on tasks of earlier ones.
    """
    links = written(pairs, "links")
    moves = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        move = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        move = written(move.select("node", F.least("node", "b").alias("to")), "moves")
        moves.append(move)
        a = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(a, "a").join(b, "b").where("x <> y")
        links = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for move in reversed(moves):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k1``, ``k2``, ``doc_id``, ``fp`` of every row; and ``fp``, ``component``, ``component_id``
    of every fingerprint."""
    rows = written(fingerprints(docs), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("component"))
    ids = placed.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("component_id"))
    # null-safe, so that the join has an exchange of its own and a large component is split
    placed = placed.join(ids, F.col("component").eqNullSafe(F.col("of")))
    return rows, placed.select("fp", "component", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` and ``component_id``, the smallest doc_id reachable
    over links.

    NULL, empty and blank texts have the fingerprint zero and are linked like any other. Texts of
    any length are hashed whole, in blocks of shingles. Rows with NULL ids take part but name no
    component unless all its ids are NULL. Repeated rows give repeated results, an empty table an
    empty one; other columns are not read.
    """
    rows, placed = near_duplicates(docs)
    out = rows.join(placed.select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; of rows
    with that same id, the one with the smallest key."""
    rows, placed = near_duplicates(docs)
    return first_rows(docs, rows, placed, "fp")


def first_rows(docs: DataFrame, rows: DataFrame, placed: DataFrame, by: str) -> DataFrame:
    """The first row of each component, with all its columns; ``by`` leads from a row to its component."""
    first = rows.join(placed, by).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    every = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return every.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
