"""Exact, linearly interpolated quantiles without sorting or gathering a column.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here order
statistics are found by narrowing: count the rows per coarse bucket, keep only the buckets that
hold a wanted rank, split those again, and stop when a bucket holds a single value. Each pass is
a column-pruned scan and a map-side combined count, so nothing but bucket counts is shuffled and
a hot value costs no more than any other.

The buckets are monotone in the value, which is all that correctness needs. The first pass cuts
by sign and sixteenths of an octave (at most ~67,000 buckets). A bucket with at most
``LAST_ROWS`` rows is then counted value by value; a larger one has its own ``[lo, hi]`` cut into
65,536 equal parts. A double has 2^48 values in a sixteenth of an octave, so after two such
passes about 2^16 distinct values are left at most, and these are counted one by one too. That
bounds the rows of every window below.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.lineage import cut
from dqspark.operators.ranks import ranks_in_place
from dqspark.types import chunks, double_literal, melt, quoted, ref

PARTS = 65_536
PASSES = 3  # after the coarse one
LAST_ROWS = 200_000
# A target table of at most this many rows (a hundred bytes each) is broadcast to the next pass.
BROADCAST_ROWS = 20_000
COLUMNS_AT_ONCE = 40
# Columns in one filter of literals: Catalyst derives a constraint for every subset of computed
# columns in a predicate, so one over many of them would never be planned. Parquet reads only the
# columns of a pass, so splitting a pass reads no more bytes.
FILTERED_AT_ONCE = 6

_RANK = T.StructType(
    [
        T.StructField("p", T.IntegerType()),
        T.StructField("upper", T.BooleanType()),
        T.StructField("frac", T.DoubleType()),
        T.StructField("rank", T.LongType()),
    ]
)
_TARGET_FIELDS = [
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("ranks", T.ArrayType(_RANK)),
]

_OCTAVE = "cast(floor(least(log2(abs(value)), 1100D) * 16) AS int) + 20000"
COARSE = f"CASE WHEN value > 0 THEN {_OCTAVE} WHEN value < 0 THEN -({_OCTAVE}) ELSE 0 END"


def _part(value: str, lo: str, hi: str) -> str:
    """The place of a value inside a bucket's range."""
    share = f"try_divide({value} - {lo}, {hi} - {lo})"
    return f"CASE WHEN {hi} > {lo} THEN floor({share} * {PARTS - 1}) ELSE 0 END"


def _hits(buckets: DataFrame, group: list[str], ranks: str = "ranks") -> DataFrame:
    """The buckets that hold a wanted rank, each with its ranks re-based to its first row."""
    by = ", ".join(quoted(g) for g in group)
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY part)"
    placed = buckets.selectExpr("*", f"sum(n) {over} - n AS below")
    inside = f"filter({ranks}, r -> r.rank >= below AND r.rank < below + n)"
    moved = "named_struct('p', r.p, 'upper', r.upper, 'frac', r.frac, 'rank', r.rank - below)"
    return placed.withColumn("ranks", F.expr(f"transform({inside}, r -> {moved})")).where(
        "size(ranks) > 0"
    )


def _counted(data: DataFrame, group: list[str]) -> DataFrame:
    return data.groupBy(*[ref(g) for g in group], "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )


def _first_targets(data: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """Pass 1: bucket the whole column and place every wanted rank."""
    by = ", ".join(quoted(k) for k in keys)
    buckets = _counted(data.selectExpr("*", f"{COARSE} AS part"), keys).selectExpr(
        "*", f"sum(n) OVER ({f'PARTITION BY {by}' if by else ''}) AS total"
    )
    wanted = []
    for i, p in enumerate(probs):
        at = f"(total - 1) * {double_literal(p)}"
        for upper, rank in (("false", f"floor({at})"), ("true", f"ceil({at})")):
            wanted.append(
                f"named_struct('p', {i}, 'upper', {upper}, 'frac', {at} - floor({at}), "
                f"'rank', cast({rank} AS bigint))"
            )
    hit = _hits(buckets, keys, f"array({', '.join(wanted)})")
    return hit.select(*[ref(k) for k in keys], "lo", "hi", "n", "ranks")


def _narrow(data: DataFrame, targets: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One more pass over the rows that lie inside a target bucket, by a join on the keys."""
    t = targets.select(*[ref(k).alias(f"t_{k}") for k in keys], "lo", "hi", "n", "ranks")
    match = F.expr("value BETWEEN lo AND hi")
    for k in keys:
        match = ref(k).eqNullSafe(ref(f"t_{k}")) & match
    one_by_one = "true" if last else f"n <= {LAST_ROWS}"
    part = f"CASE WHEN {one_by_one} THEN value ELSE {_part('value', 'lo', 'hi')} END"
    inside = data.join(t, match).select(
        *[ref(k) for k in keys], F.col("lo").alias("parent"), "ranks", "value", F.expr(part).alias("part")
    )
    hit = _hits(_counted(inside, [*keys, "parent", "ranks"]), [*keys, "parent"])
    return hit.select(*[ref(k) for k in keys], "lo", "hi", "n", "ranks")


def _narrow_columns(df: DataFrame, targets: list[Row], last: bool) -> list[Row]:
    """One more pass for known buckets of columns: their bounds are literals, so the filter on
    them reaches the scan, and only rows inside some bucket are taken apart by column."""
    keep, cells, ranks = [], [], []
    for i, t in enumerate(targets):
        x, lo, hi = f"cast({quoted(t['column'])} AS double)", double_literal(t["lo"]), double_literal(t["hi"])
        whole = isinstance(df.schema[t["column"]].dataType, T.IntegralType)
        if whole and max(abs(t["lo"]), abs(t["hi"])) < 2**53:
            # Compared as integers, since a filter on a cast would not reach the files.
            keep.append(f"{quoted(t['column'])} BETWEEN {int(t['lo'])} AND {int(t['hi'])}")
        else:
            keep.append(f"{x} BETWEEN {lo} AND {hi}")
        part = x if last or t["n"] <= LAST_ROWS else _part(x, lo, hi)
        cells.append(
            f"if({keep[-1]}, named_struct('target', {i}, 'part', cast({part} AS double), 'value', {x}), NULL)"
        )
        ranks.append(
            "array("
            + ", ".join(
                f"named_struct('p', {r['p']}, 'upper', {str(r['upper']).lower()}, "
                f"'frac', {double_literal(r['frac'])}, 'rank', {r['rank']}L)"
                for r in t["ranks"]
            )
            + ")"
        )
    inside = (
        df.where(" OR ".join(keep))
        .selectExpr(f"inline(array({', '.join(cells)}))")
        .where("target IS NOT NULL")
    )
    hit = _hits(_counted(inside, ["target"]), ["target"], f"array({', '.join(ranks)})[target]")
    rows = hit.select("target", "lo", "hi", "n", "ranks").collect()
    return [Row(column=targets[r["target"]]["column"], **r.asDict()) for r in rows]


def _split(rows: list[Row]) -> tuple[list[Row], list[Row]]:
    return [r for r in rows if r["lo"] == r["hi"]], [r for r in rows if r["lo"] != r["hi"]]


def _order_statistics(
    data: DataFrame, keys: list[str], probs: Sequence[float]
) -> tuple[DataFrame, bool]:
    """``(keys..., lo, hi, n, ranks)`` with ``lo == hi``: the value at every wanted rank.

    Also tells whether that table is known to be small.

    Target tables that fit ``BROADCAST_ROWS`` are small by that check, so they travel through the
    driver and are broadcast: the data is then never shuffled, however skewed the groups are, and
    the passes end once every rank is pinned to one value. With more groups than that, targets
    are written to the checkpoint folder and joined by key, where skewed groups are split by AQE.
    """
    spark = data.sparkSession
    key_fields = [T.StructField(k, data.schema[k].dataType) for k in keys]
    schema = T.StructType(key_fields + _TARGET_FIELDS)
    targets = _first_targets(data, keys, probs)
    done: list[Row] = []
    if keys:
        targets = cut(targets)  # read twice where there are many groups
    for step in range(PASSES + 1):
        rows = targets.limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS:
            targets = cut(targets) if step else targets
            for later in range(step, PASSES):
                targets = cut(_narrow(data, targets, keys, last=later == PASSES - 1))
            settled = spark.createDataFrame(done, schema)
            return (settled.unionByName(targets.select(*schema.names)) if done else targets), False
        settled, todo = _split(rows)
        done += settled
        if not todo:
            break
        small = F.broadcast(spark.createDataFrame(todo, schema))
        targets = _narrow(data, small, keys, last=step == PASSES - 1)
    return spark.createDataFrame(done, schema), True


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """``(keys..., q array<double>)``: one row per group, quantiles in the order of ``probs``.

    Any number of groups, of any size. Missing values are ignored; a group with none left is
    absent. Group columns may hold NULL. Where the number of groups was found to be within
    ``BROADCAST_ROWS`` the result is marked for broadcasting, to be joined to its data.
    """
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    data = df.select(
        *[ref(k).alias(n) for k, n in zip(keys, names)], ref(value).cast("double").alias("value")
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if names and data.agg(F.approx_count_distinct(F.struct(*names))).first()[0] > BROADCAST_ROWS:
        out = _of_many_groups(data, names, probs)
        return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "q")
    out, small = _narrowed(data, names, probs)
    out = out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "q")
    return F.broadcast(out) if small else out


def _narrowed(data: DataFrame, names: list[str], probs: Sequence[float]) -> tuple[DataFrame, bool]:
    """Quantiles per group by narrowing, and whether the table is known to be small."""
    targets, small = _order_statistics(data, names, probs)
    found = targets.select(*names, "lo", F.explode("ranks").alias("r"))

    def at(i: int) -> str:
        low, high = (f"max(if(r.p = {i} AND r.upper = {u}, lo, NULL))" for u in ("false", "true"))
        between = f"{low} + ({high} - {low}) * max(if(r.p = {i}, r.frac, NULL))"
        return f"CASE WHEN {low} = {high} THEN {low} ELSE {between} END"

    quantiles = F.expr(f"array({', '.join(at(i) for i in range(len(probs)))})")
    return found.groupBy(*names).agg(quantiles.alias("q")), small


def _of_many_groups(data: DataFrame, names: list[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles per group from one range shuffle; the groups on borders of its tasks, two a task at most, are narrowed."""
    found = cut(ranks_in_place(data, names, probs))
    border = found.where("q IS NULL").select(*[F.col(n).alias(f"b_{n}") for n in names]).distinct()
    same = [F.col(n).eqNullSafe(F.col(f"b_{n}")) for n in names]
    rest, _ = _narrowed(data.join(border, reduce(Column.__and__, same), "left_semi"), names, probs)
    return found.where("q IS NOT NULL").select(*names, "q").unionByName(rest.select(*names, "q"))


def _between(low: float, frac: float, high: float) -> float:
    return low if low == high else low + (high - low) * frac


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float] | None]:
    """Quantiles of several numeric columns at once, as Python floats.

    A column without values maps to ``None``. What comes back to the driver between passes is at
    most ``2 * len(probs)`` rows per column.
    """
    out: dict[str, list[float] | None] = {}
    for part in chunks(list(columns), COLUMNS_AT_ONCE):
        done, todo = _split(_first_targets(melt(df, part, "double"), ["column"], probs).collect())
        step = 0
        while todo:
            found: list[Row] = []
            for few in chunks(sorted({r["column"] for r in todo}), FILTERED_AT_ONCE):
                part_of = [r for r in todo if r["column"] in few]
                found += _narrow_columns(df, part_of, last=step == PASSES - 1)
            settled, todo = _split(found)
            done += settled
            step += 1
        sides: dict[str, dict] = {}
        for r in done:
            for rank in r["ranks"]:
                sides.setdefault(r["column"], {})[rank["p"], rank["upper"]] = (r["lo"], rank["frac"])
        for c in part:
            at = sides.get(c)
            out[c] = at and [_between(*at[i, False], at[i, True][0]) for i in range(len(probs))]
    return out
