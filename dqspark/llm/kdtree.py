"""Exact search for the largest inner products, by a KD-tree per shard.

Vectors are dealt into shards. Each shard is split at medians of its widest dimension into a tree whose
nodes have tight bounding boxes. The best inner product that a query can have in a box is known from the
box's corners alone; a search opens the box with the best such bound first, and ends when that is below the
k-th score found so far. The k-th scores of a first shard are handed to the searches of all others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import ship, written

#: Vectors of a shard and of a leaf; queries that search together; what a component is multiplied by.
SHARD, LEAF, BLOCK, SCALE = 8192, 64, 1024, 256
NOTHING = -np.iinfo(np.int64).max  # its negative is a long too


@dataclass
class Tree:
    """Nodes in the order in which they were split; leaves hold a slice of the points."""

    points: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray  # the first of a node's two children, -1 for a leaf
    span: np.ndarray


def exact(a: np.ndarray) -> np.ndarray:
    """Numbers in the fastest form in which sums of products are exact: doubles, else Python's own."""
    if not a.size or np.abs(a).max() < 1 << 20:
        return a.astype(np.float64)
    return whole(a)


def whole(a: np.ndarray) -> np.ndarray:
    """Numbers as Python's own whole numbers."""
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


def build(points: np.ndarray, ids: np.ndarray) -> Tree:
    """Split at the median of the widest dimension until a leaf is small or all its points are the same."""
    order = np.arange(len(ids))
    low, high, child, span = [], [], [], []

    def add(a: int, b: int) -> None:
        own = points[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        child.append(-1)
        span.append((a, b))

    add(0, len(ids))
    node = 0
    while node < len(span):
        a, b = span[node]
        width = high[node] - low[node]
        wide = int(width.argmax()) if width.size else 0  # vectors without components are all the same
        if b - a > LEAF and width.any():
            order[a:b] = order[a:b][np.argsort(points[order[a:b], wide], kind="stable")]
            child[node] = len(span)
            add(a, (a + b) // 2)
            add((a + b) // 2, b)
        node += 1
    return Tree(points[order], ids[order], np.array(low), np.array(high), np.array(child), np.array(span))


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids of every query in a tree, those below ``kth`` left out at will.

    All queries go in step: each opens its best box that is still closed. A box whose bound equals
    the k-th score is opened too, for it may hold a smaller id.
    """
    q, points, low, high = exact(queries), exact(tree.points), exact(tree.low), exact(tree.high)
    if object in (q.dtype, points.dtype):
        q, points, low, high = (whole(x) for x in (queries, tree.points, tree.low, tree.high))
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    closed = np.full(bounds.shape, -np.inf)
    closed[:, 0] = bounds[:, 0].astype(float)
    if bounds.dtype == object:  # beyond doubles: a bound must not be rounded down
        closed[:, 0] = np.inf
    scores = np.full((len(q), k), NOTHING, dtype=np.int64 if q.dtype != object else object)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    need = kth.copy()
    todo = np.arange(len(q))
    while len(todo):
        best = closed[todo].argmax(axis=1)
        bound = closed[todo, best]
        go = (bound > -np.inf) & (bound >= need[todo])
        todo, best = todo[go], best[go]
        closed[todo, best] = -np.inf
        for node in np.unique(best):
            who = todo[best == node]
            first = tree.child[node]
            if first >= 0:
                for c in (first, first + 1):
                    closed[who, c] = bounds[who, c].astype(float) if bounds.dtype != object else np.inf
                continue
            a, b = tree.span[node]
            got = q[who] @ points[a:b].T
            got = got if got.dtype == object else got.astype(np.int64)
            names = np.broadcast_to(tree.ids[a:b], got.shape)
            got = np.where(names == own[who, None], NOTHING, got)
            all_scores, all_ids = np.hstack([scores[who], got]), np.hstack([ids[who], names])
            order = np.stack([np.lexsort((i, -s)) for s, i in zip(all_scores, all_ids)])[:, :k]
            scores[who] = np.take_along_axis(all_scores, order, 1)
            ids[who] = np.take_along_axis(all_ids, order, 1)
            need[who] = np.maximum(need[who], scores[who, -1].astype(float))
    return scores, ids


def whole_vectors(table: DataFrame, ident: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``v``, the components times ``scale``, rounded down, as doubles that hold them exactly; rows without an
    id, without a vector, or with a component that is NULL or not finite, itself or times ``scale``, are left out."""
    x = F.transform(table[vector], lambda c: c.cast("double") * scale)
    df = table.select(table[ident].cast("bigint").alias("id"), x.alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    df = df.where("id IS NOT NULL AND x IS NOT NULL").where(sound)
    # a double of 2^53 or more has no fraction
    floor = F.transform("x", lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    return df.select("id", floor.alias("v"), F.size("x").alias("dim"))


def top_k(table: DataFrame, every: int, k: int = 5, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` other rows with the largest inner
    products: ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller id.

    Vectors that are NULL, or hold a NULL or a component that is not finite (or not so once multiplied), take no part.
    Scores are exact, however large the components; one that no long can hold is given as the nearest that can. Vectors of different
    lengths do not meet; those without components score 0 with each other. Of equal vectors only the k + 1 smallest ids can ever be returned, so only
    those enter a tree, however many copies there are; repeated rows count once. An empty table gives an
    empty one; other columns are not read.
    """
    spark = table.sparkSession
    ship(spark)
    vectors = whole_vectors(table, ident, vector).dropDuplicates(["id", "v"])
    copies = Window.partitionBy("v").orderBy("id")
    distinct = vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    points = written(distinct, "points")
    asked = written(vectors.where(F.col("id") % every == 0), "queries")
    sizes = points.groupBy("dim").count().collect()  # one row per vector length
    shards = spark.createDataFrame([(r["dim"], -(-r["count"] // SHARD)) for r in sizes], "dim int, shards bigint")
    asked_of = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    blocks = spark.createDataFrame([(d, -(-n // BLOCK)) for d, n in asked_of.items()], "dim int, blocks bigint")

    def packed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("id")
        return np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["id"].to_numpy(np.int64)

    def planted(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [pickle.dumps(build(*packed(pdf)))]})

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "asked": [pickle.dumps(packed(pdf))]})

    dealt = points.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), "shards"))
    trees = dealt.groupBy("dim", "shard").applyInPandas(planted, "dim int, shard bigint, tree binary")
    trees = written(trees.join(F.broadcast(shards), "dim").join(F.broadcast(blocks), "dim"), "trees")
    grouped = asked.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    grouped = written(grouped.groupBy("dim", "block").applyInPandas(gathered, "dim int, block bigint, asked binary"), "blocks")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                queries, own = pickle.loads(row.asked)
                known = dict(zip(row.known_ids, row.known)) if row.known_ids is not None else {}
                kth = np.array([known.get(i, -np.inf) for i in own.tolist()], float)
                scores, ids = search(pickle.loads(row.tree), queries, own, kth, k)
                keep = scores != NOTHING
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(own, k)[keep.ravel()],
                        "vec_id": ids[keep],
                        "score": np.clip(scores[keep], NOTHING + 1, -NOTHING).astype(np.int64),
                    }
                )

    schema = "query_id bigint, vec_id bigint, score bigint"
    no_bounds = (F.lit(None).cast("array<bigint>").alias("known_ids"), F.lit(None).cast("array<double>").alias("known"))
    # each block of queries first searches one shard, then, with what that gave, all others
    home = trees.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    at_home = F.col("shard") == F.col("block") % F.col("shards")
    first = home.where(at_home).join(grouped, ["dim", "block"]).select("tree", "asked", *no_bounds)
    first = written(first.repartition(F.xxhash64("asked")).mapInPandas(searched, schema), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bound = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    bound = bound.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    bound = bound.join(asked.select("id", "dim"), "id").join(F.broadcast(blocks), "dim")
    bound = bound.groupBy("dim", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    bound = bound.agg(F.collect_list("id").alias("known_ids"), F.collect_list("kth").alias("known"))
    rest = home.where(~at_home).join(grouped.join(bound, ["dim", "block"], "left"), ["dim", "block"])
    rest = rest.repartition("dim", "block", "shard").select("tree", "asked", "known_ids", "known").mapInPandas(searched, schema)
    every_hit = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every_hit.select("query_id", "rank", "vec_id", "score")
