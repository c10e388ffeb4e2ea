"""Moments of all pairs of columns in one scan: counts, means and centred products, pairwise complete.

A batch of rows is a matrix; its products with itself and with the matrix of present cells (Gram matrices)
give, for every pair of columns, the moments over the rows that have both. Moments of batches, then of
tasks, are merged by the pairwise update of Chan et al. (1983), which loses nothing to cancellation, as a tree: some tasks
at a time, then those sums. A column that is constant has a second moment of exactly zero in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.types import ref

#: States merged at a time on the first level of the tree.
FAN_IN = 128
#: Of a pair (i, j): rows with both, means of i and of j there, second moments of i and of j, and the product moment.
FIELDS = ["n", "mean", "other_mean", "square", "other_square", "product"]


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, ``i`` its place: arrays over the other columns' places, named as ``FIELDS``.

    Missing cells are NULL or NaN; a pair with an infinite value has the moment NaN. An empty table has no rows.
    A task holds a few matrices of the number of columns squared.
    """
    width, fields = len(columns), FIELDS

    def moments(x: np.ndarray) -> dict[str, np.ndarray]:
        there, finite = ~np.isnan(x), np.isfinite(x)
        m = there.astype(float)
        first = np.where(finite.any(axis=0), x[finite.argmax(axis=0), np.arange(width)], 0.0)
        u = np.where(finite, x, first) - first
        centre = u.sum(axis=0) / np.maximum(1, finite.sum(axis=0))
        u = np.where(finite, u - centre, 0.0)
        n, s, raw = m.T @ m, u.T @ m, (u * u).T @ m
        a = s / np.maximum(n, 1)
        square = raw - s * a
        square[square <= 1e-14 * raw] = 0.0  # nothing but rounding
        square[(there & ~finite).astype(float).T @ m > 0] = np.nan
        mean = np.where(n > 0, (first + centre)[:, None] + a, 0.0)
        parts = (n, mean, mean.T, square, square.T, u.T @ u - s * a.T)
        return dict(zip(fields, parts))

    def merged(a: dict, b: dict) -> dict:
        n = a["n"] + b["n"]
        share = b["n"] / np.maximum(n, 1)
        weight = a["n"] * share
        d, e = b["mean"] - a["mean"], b["other_mean"] - a["other_mean"]
        parts = (
            n,
            a["mean"] + d * share,
            a["other_mean"] + e * share,
            a["square"] + b["square"] + d * d * weight,
            a["other_square"] + b["other_square"] + e * e * weight,
            a["product"] + b["product"] + d * e * weight,
        )
        return dict(zip(fields, parts))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                own = moments(x)
                state = own if state is None else merged(state, own)
        if state is not None:
            for i in range(width):
                cells = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([i], pa.int32())]
                cells += [pa.array([state[f][i]], pa.list_(pa.float64())) for f in fields]
                yield pa.RecordBatch.from_arrays(cells, ["part", "i", *fields])

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        state = None
        for _, row in pdf.sort_values("part").iterrows():
            own = {f: np.asarray(row[f], float) for f in fields}
            state = own if state is None else merged(state, own)
        return pd.DataFrame({"part": [pdf["part"].min()], "i": [pdf["i"].iloc[0]], **{f: [state[f]] for f in fields}})

    schema = "part bigint, i int, " + ", ".join(f"{f} array<double>" for f in fields)
    states = df.select(*[ref(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(scanned, schema)
    some = states.groupBy("i", F.expr(f"part div {FAN_IN}")).applyInPandas(folded, schema)
    return some.groupBy("i").applyInPandas(folded, schema).drop("part")


def pair_sums(df: DataFrame, columns: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """``(i, j, n, u, v, uu, vv, uv)``: plain sums over the rows that have both of two columns, of their distances from a given
    centre and of the products of these, added up by Spark. Infinite values give NaN."""
    width, about = len(columns), np.array([0.0 if c is None else c for c in centre], float)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            m = (~np.isnan(x)).astype(float)
            d = np.where(m > 0, x - about, 0.0)
            with np.errstate(invalid="ignore"):
                u, uu = d.T @ m, (d * d).T @ m
                sums += np.stack([m.T @ m, u, u.T, uu, uu.T, d.T @ d])
        for i in range(width):
            cells = [pa.array([i], pa.int32())] + [pa.array([s[i]], pa.list_(pa.float64())) for s in sums]
            yield pa.RecordBatch.from_arrays(cells, ["i", *names])

    names = ["n", "u", "v", "uu", "vv", "uv"]
    data = df.select(*[ref(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    rows = data.mapInArrow(scanned, "i int, " + ", ".join(f"{s} array<double>" for s in names))
    cells = rows.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "x")).select("i", "j", "x.*")
    return cells.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in names])


def all_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, column_a, column_b)`` of every two columns, in both orders."""
    names = F.array(*[F.lit(c) for c in columns])
    one = df.sparkSession.range(1).select(F.posexplode(names).alias("i", "column_a"))
    return one.select("i", "column_a", F.posexplode(names).alias("j", "column_b"))
