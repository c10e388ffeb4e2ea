"""Quantiles of very many groups: rows dealt once by ranges of (group, value), wanted ranks read in place.

After one shuffle every task holds a stretch of the sorted whole. A group that lies within one task is
complete there, and its ranks are places in the sorted values. Only the first and the last group of a task may go on in
another; there are at most two such groups per task, and they are left to the caller. Ranges are cut by value and by
the task that read a row, too, so neither a hot group nor a hot value of one is more than its share of a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranks_in_place(data: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """``(keys..., q, n)`` from non-missing ``value`` of each group; ``q`` is NULL for a group that lies on the border
    of a task, which may have several such rows. Groups may have NULL keys."""
    spark = data.sparkSession
    n_keys, wanted = len(keys), np.array(list(probs), float)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = data.withColumn("salt", F.xxhash64(F.spark_partition_id()))
    dealt = dealt.repartitionByRange(tasks, *[F.col(k) for k in keys], "value", "salt")
    ordered = dealt.select(*keys, "value").sortWithinPartitions(*keys, "value")
    names = [*keys, "q", "n"]

    def differs(a: pa.Array, b: pa.Array) -> np.ndarray:
        """Where two columns differ; NULLs are equal, and so are NaNs."""
        out = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(a.type):
            out = pc.and_not(out, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
        return out.to_numpy(zero_copy_only=False)

    def at_ranks(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        place = (counts[:, None] - 1) * wanted
        low = np.floor(place).astype(np.int64)
        a = values[starts[:, None] + low]
        b = values[starts[:, None] + np.ceil(place).astype(np.int64)]
        with np.errstate(invalid="ignore"):
            return np.where(a == b, a, a + (b - a) * (place - low))

    def rows(key_columns: list[pa.Array], q: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        lists = pa.array(list(q) if q is not None else [None] * len(n), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*key_columns, lists, pa.array(n, pa.int64())], names)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # values of the group that may go on
        key: list[pa.Array] | None = None  # its keys, one row each
        size, is_first = 0, True

        def closed() -> pa.RecordBatch:
            if is_first:
                return rows(key, None, np.array([size]))
            return rows(key, at_ranks(np.concatenate(held), np.array([0]), np.array([size])), np.array([size]))

        for batch in batches:
            total = batch.num_rows
            if not total:
                continue
            columns, values = batch.columns[:n_keys], batch.column(n_keys).to_numpy(zero_copy_only=False)
            change = np.zeros(total, bool)
            for k, c in enumerate(columns):
                change[1:] |= differs(c.slice(0, total - 1), c.slice(1))
                if key is not None:
                    change[0] |= differs(key[k], c.slice(0, 1))[0]
            starts = np.flatnonzero(change) if key is not None else np.flatnonzero(np.append(True, change[1:]))
            ends = np.append(starts[1:], total)
            ahead = int(starts[0]) if len(starts) else total  # rows of the group that was open
            if ahead:
                size += ahead
                if not is_first:
                    held.append(values[:ahead])
            if not len(starts):
                continue
            if key is not None:
                yield closed()
                is_first = False
            inner = slice(1, -1) if key is None else slice(0, -1)  # the very first group stays open to the left
            if key is None and len(starts) > 1:
                yield rows([c.slice(0, 1) for c in columns], None, (ends - starts)[:1])
                is_first = False
            if len(starts[inner]):
                own = pa.array(starts[inner])
                counts = (ends - starts)[inner]
                yield rows([c.take(own) for c in columns], at_ranks(values, starts[inner], counts), counts)
            last = int(starts[-1])
            key, size = [c.slice(last, 1) for c in columns], total - last
            held = [] if is_first else [values[last:]]
        if key is not None:
            yield rows(key, None, np.array([size]))

    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInArrow(scanned, f"{kinds}, q array<double>, n bigint")
