"""Mixing sources to target weights, block by block.

The words of each source, its documents in the order of a hash of their rows, form one stream cut
into blocks of ``BLOCK`` words. A source takes part in the mix with as many slots as its target asks
for. How many of them each output shard gets is drawn: the counts of the sources in the shards are
multinomial, given that a source's counts add up to its slots, and are found by halving the range of
shards with binomial draws, so that any task can tell a shard's counts without the others. A shard
owns the next run of that many slots of the source. The slots of a source run through its blocks in
the order of a pseudorandom permutation of the block numbers, a new one for every pass, so a block
is taken at most once more than any other. Slots and blocks meet in a join by block number.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import row_keys, ship, words, written

#: Words of a block; groups that a source's documents are summed up in; slots of a shard, on average.
BLOCK, GROUPS, SHARD = 32, 1 << 20, 1 << 15
WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 7


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Words wanted of each source: by weight, at most ``repeats`` times its size, the excess
    shared by weight among the others until none is above."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / whole > repeats * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in sorted(over):
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def mixed64(x: np.ndarray) -> np.ndarray:
    """A pseudorandom function of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Where a permutation of 0..n-1 chosen by ``key`` puts ``i``: a balanced Feistel network on the
    next even number of bits, walked on until the value is below n."""
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < n).any():
        half += small.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(rounds):
                f = mixed64(right * np.uint64(0x9E3779B97F4A7C15) + mixed64(k + np.uint64(r)))
                left, right = right, left ^ (f & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def blocks_of(slot: np.ndarray, blocks: int, source: int) -> np.ndarray:
    """The blocks that slots of a source take."""
    j, n = slot.astype(np.uint64), np.uint64(blocks)
    key = np.uint64(source * 1_000_003 + SEED) + (j // n) * np.uint64(7_919)
    return permuted(j % n, np.full(len(j), n), key)


def laid_out(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each document lies in its source's stream of words, and the table of sources.

    Documents: ``k1``, ``k2``, ``doc_id``, ``size``, ``rank`` of the source, ``start``. Sources: ``rank``,
    ``source_size``, ``target``, ``blocks``, ``slots``; a mix names its sources one by one, so this table
    is read by the driver: one row per source, whatever the number of documents.
    """
    spark = docs.sparkSession
    ship(spark)
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    rows = docs.select(
        k1.alias("k1"), k2.alias("k2"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        F.size(words(docs["text"])).cast("bigint").alias("size"),
    )
    rows = written(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]
    table = []
    for rank, (r, target) in enumerate(zip(found, targets([r["n"] for r in found], weights))):
        blocks = -(-r["n"] // BLOCK)
        slots = min(REPEATS * blocks, round(target * blocks / r["n"])) if r["n"] else 0
        table.append((rank, r["source"], r["n"], target, blocks, slots))
    sources = spark.createDataFrame(
        table, "rank int, source string, source_size bigint, target double, blocks bigint, slots bigint"
    )
    names = F.broadcast(sources.select("rank", F.col("source").alias("name")))
    rows = rows.join(names, rows.source.eqNullSafe(names.name)).drop("source", "name")
    # a sum over a whole source is two sums: over the documents of a group of hashes, and over the groups
    rows = rows.withColumn("part", F.pmod("k1", F.lit(GROUPS)))
    some = rows.where("size > 0")
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = some.groupBy("rank", "part").agg(F.sum("size").alias("n"))
    groups = groups.select("rank", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "part").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(groups, ["rank", "part"])
    some = some.select("k1", "k2", "doc_id", "rank", "size", (F.col("base") + F.col("inside")).alias("start"))
    empty = rows.where("size = 0").select("k1", "k2", "doc_id", "rank", "size", F.lit(0).cast("bigint").alias("start"))
    return written(some.unionByName(empty), "layout"), sources


@functools.lru_cache(1 << 12)
def drawn_left(source: int, low: int, high: int, slots: int) -> int:
    """How many of the slots thrown into shards ``low`` to ``high`` fall into the lower half of these."""
    random = np.random.Generator(np.random.Philox(np.random.SeedSequence((SEED, source, low, high))))
    return int(random.binomial(slots, ((low + high) // 2 - low) / (high - low)))


def drawn(shard: int, shards: int, source: int, slots: int) -> tuple[int, int]:
    """The first slot and the number of slots of a source that a shard owns."""
    low, high, first = 0, shards, 0
    while high - low > 1:
        middle, left = (low + high) // 2, drawn_left(source, low, high, slots)
        if shard < middle:
            high, slots = middle, left
        else:
            low, first, slots = middle, first + left, slots - left
    return first, slots


def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of shards and sources, one batch for each of these: ``shard``, ``rank``, ``slot``, ``block``."""
    for batch in batches:
        for shard, rank, shards, blocks, slots in zip(*(c.to_pylist() for c in batch.columns)):
            first, count = drawn(shard, shards, rank, slots)
            if count:
                slot = np.arange(first, first + count)
                found = blocks_of(slot, blocks, rank)
                arrays = [np.full(count, shard), np.full(count, rank, np.int32), slot, found]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["shard", "rank", "slot", "block"])


def slot_table(sources: DataFrame) -> DataFrame:
    """The mix: ``shard``, ``place`` (its order there), ``rank`` and ``block`` of every slot.

    A task draws the counts of some shards and unfolds the slots that these own, a shard and source at a time.
    """
    spark = sources.sparkSession
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    shards = max(1, -(-total // SHARD))
    tasks = max(1, min(n * shards, max(spark.sparkContext.defaultParallelism, shards // 64)))
    every = spark.range(0, n * shards, 1, tasks).select(
        F.expr(f"id DIV {max(1, n)}").alias("shard"), F.expr(f"id % {max(1, n)}").cast("int").alias("rank")
    )
    every = every.join(F.broadcast(sources), "rank").where("slots > 0")
    slots = every.select("shard", "rank", F.lit(shards).cast("bigint").alias("shards"), "blocks", "slots")
    slots = slots.mapInArrow(unfolded, "shard bigint, rank int, slot bigint, block bigint")
    return slots.select("shard", F.xxhash64(F.lit(SEED), "rank", "slot").alias("place"), "rank", "block")


def cut_at_blocks(rows: DataFrame) -> DataFrame:
    """Each document with words cut at block borders: ``block``, ``from`` and ``words`` (counted in the document)."""
    first, last = f"start DIV {BLOCK}", f"(start + size - 1) DIV {BLOCK}"
    cut = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence({first}, {last})")))
    begin = F.expr(f"greatest(start, block * {BLOCK})")
    end = F.expr(f"least(start + size, (block + 1) * {BLOCK})")
    return cut.withColumn("from", begin - F.col("start")).withColumn("words", end - begin)


def pieces(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The pieces of documents with ``times``, how often the mix takes their block, and the least and
    greatest shard that does, ``low`` and ``high``."""
    found = slot_table(sources).groupBy("rank", "block")
    found = found.agg(F.count("*").alias("times"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    return cut_at_blocks(rows).join(found, ["rank", "block"], "left").na.fill(0, ["times"])


def mix(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, and the least and
    greatest output shard that holds a part of it, ``first_shard`` and ``last_shard`` (NULL: none does).

    NULL and empty texts have no words and are never taken; NULL is a source of its own, the last.
    Repeated rows, and rows with NULL ids, are documents of their own. The same rows give the same
    mix, whatever their partitions. An empty table gives an empty one; other columns are not read.
    """
    rows, sources = laid_out(docs)
    taken = pieces(rows, sources).groupBy("rank", "start", "doc_id", "size").agg(
        F.sum(F.expr("words * times")).alias("taken"),
        F.min("low").alias("first_shard"),
        F.max("high").alias("last_shard"),
    )
    empty = rows.where("size = 0").select("rank", "start", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    every = taken.unionByName(empty, allowMissingColumns=True).join(F.broadcast(sources), "rank")
    return every.select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The mix itself, shard by shard: ``shard``, ``place`` (a block's order in its shard), ``source``,
    ``block``, and the pieces that make up the block, in order: ``doc_id``, ``piece`` (first word,
    counted in the document) and ``words``.

    A block that lies in several documents has one row for each. Rows are dealt and sorted by
    shard, so that each is one run of an output file. Without words there are no rows.
    """
    rows, sources = laid_out(docs)
    found = slot_table(sources).join(cut_at_blocks(rows), ["rank", "block"])
    found = found.join(F.broadcast(sources.select("rank", "source")), "rank")
    found = found.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "start")
    return found.select("shard", "place", "source", "block", "doc_id", F.col("from").alias("piece"), "words")


def cut_texts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[str]:
    """For each pass of the mix over a document, the text of its blocks taken in that pass.

    ``spans``: first word, number of words and how often taken, in order. A document taken whole
    keeps its text as it is; otherwise runs of words keep what stands between them.
    """
    import re

    found = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for again in range(1, max(t for _, _, t in spans) + 1):
        runs: list[list[int]] = []
        for at, n, times in spans:
            if times >= again:
                if runs and runs[-1][1] == at:
                    runs[-1][1] = at + n
                else:
                    runs.append([at, at + n])
        if runs == [[0, len(found)]]:
            yield text
        elif runs:
            yield "\n".join(text[found[a][0] : found[b - 1][1]] for a, b in runs)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, with their columns: those in no block are left out, a
    document taken twice comes twice, and its text holds the blocks of that pass. NULL and empty
    texts are in no block; an empty table gives an empty one."""
    rows, sources = laid_out(docs)
    spans = (
        pieces(rows, sources)
        .groupBy("k1", "k2", "rank", "start")
        .agg(F.sort_array(F.collect_list(F.struct("from", "words", "times"))).alias("spans"), F.max("times").alias("most"))
        .where("most > 0")
        .select("k1", "k2", "spans")
    )
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    every = docs.select(k1.alias("k1"), k2.alias("k2"), *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    joined = every.dropDuplicates(["k1", "k2"]).join(spans, ["k1", "k2"]).drop("k1", "k2")
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    width = len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at).to_pylist(), batch.column(width).to_pylist()
            take, new = [], []
            for i, (t, spans_) in enumerate(zip(texts, lists)):
                for part in cut_texts(t, [(s["from"], s["words"], s["times"]) for s in spans_]):
                    take.append(i)
                    new.append(part)
            chosen = batch.select(range(width)).take(pa.array(take, pa.int64()))
            columns = list(chosen.columns)
            columns[at] = pa.array(new, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in new]).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=chosen.schema.names)

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return joined.mapInArrow(cut, schema).toDF(*docs.columns)
