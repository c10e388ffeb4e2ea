"""Similarity self-join of distinct labels, and greedy merging of similar labels.

Similarity is the normalised indel one, ``2 * LCS / (|a| + |b|)``. Comparing all labels with all
is quadratic, so pairs are first blocked, without losing any:

* A pair of lengths ``s <= l`` reaches the threshold ``t`` only with an LCS of at least
  ``need = ceil(t * (s + l) / 2)``, that is with at most ``edits = s + l - 2 * need`` unmatched
  characters. Cut the shorter label into ``edits + 1`` segments: each unmatched character spoils
  at most one, so one segment occurs unbroken in the longer label, moved left by at most
  ``s - need`` or right by at most ``l - need`` characters (the pigeonhole argument of Li et al.,
  PassJoin, 2011). Labels therefore meet in blocks keyed by both lengths, the segment's number
  and its text.
* The segments of a label and the places to look for them grow with the cube of its length. Pairs
  whose longer label has ``LONG`` characters or more therefore meet over pairs of neighbouring characters:
  an unmatched character spoils two of them at most, so with at most ``edits`` unmatched ones
  the first ``2 * edits + 1`` of both labels' pairs, the rarest first, have one in common (the prefix filter
  of Chaudhuri et al., 2006). That is less than one key for each character.
* Where there are more segments than characters (thresholds below about 0.7) the blocks are the
  prefixes of the sorted character multisets instead (Chaudhuri et al., 2006).

Blocks with more rows than ``BLOCK_ROWS`` are cut into chunks on both sides and joined chunk by
chunk, so no task sees more than ``BLOCK_ROWS`` squared candidates of one block. A pair is kept
only in the first block it shares, so nothing has to be deduplicated afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.text import bit_alphabet, bit_masks, chars, clean_label, lcs_length
from dqspark.lineage import cut
from dqspark.types import melt, ref, require

DEFAULT_THRESHOLD = 0.85  # fixed value: the threshold below which labels count as different
SLACK = 1e-9
BLOCK_ROWS = 4_000
LONG = 32
AHEAD = 16  # labels of a block that the first round of merging looks at
SMALL = 2_000  # a table of no more labels is settled in one round: all its pairs are a bounded number


def _need(t: float) -> str:
    """The LCS a pair of lengths ``short`` and ``long`` must have."""
    return f"cast(ceil((short + long) * {t / 2!r}D - {SLACK!r}D) AS int)"


# Segments of the shorter label, as SQL over short, long and need; {i} stands for the number.
PARTS = "(short + long - 2 * need + 1)"
WIDTH = f"(short div {PARTS} + if({{i}} >= {PARTS} - short % {PARTS}, 1, 0))"
START = f"({{i}} * (short div {PARTS}) + greatest({{i}} - ({PARTS} - short % {PARTS}), 0) + 1)"
# First and last place in the longer label where the segment may stand.
FIRST = f"greatest({START} - (short - need), 1)"
LAST = f"least({START} + (long - need), long - {WIDTH} + 1)"


def _int(sql: str, i: str) -> str:
    return f"cast({sql.replace('{i}', i)} AS int)"


def _tokens(label: str, how_many: str) -> str:
    """The first characters of the sorted multiset, numbered so that repeats stay apart."""
    letters = chars(label)
    nth = f"size(filter(slice({letters}, 1, k + 1), y -> y = x))"
    return f"slice(array_sort(transform({letters}, (x, k) -> concat(x, cast({nth} AS string)))), 1, {how_many})"


def _by_grams(t: float) -> bool:
    """Whether the pairs of characters that must be spared are some, however long the labels are."""
    return 4 * (1 - t) / t <= 0.9


def _grams(labels: DataFrame, keys: list[str], t: float) -> DataFrame:
    """``(keys..., label, gram, nth)``: pairs of neighbouring characters, repeats numbered."""
    least = f"cast(ceil({LONG} * {t / (2 - t)!r}D - {SLACK!r}D) AS int)"
    each = labels.where(F.expr(f"length(label) >= {least}")).select(
        *keys, "label", F.expr("explode(transform(sequence(1, length(label) - 1), p -> substring(label, p, 2))) AS gram")
    )
    counted = each.groupBy(*keys, "label", "gram").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, "label", "gram", F.explode(F.expr("sequence(1L, n)")).alias("nth"))


def _rarest(grams: DataFrame, counts: DataFrame, keys: list[str], t: float) -> DataFrame:
    """Of every label's grams as many of the rarest as its unmatched characters could spoil, and one more."""
    spoilt = f"2 * cast(floor(length(label) * {2 * (1 - t) / t!r}D + {SLACK!r}D) AS int)"
    order = Window.partitionBy(*keys, "label").orderBy("often", "gram", "nth")
    ranked = grams.join(counts, [*keys, "gram", "nth"]).withColumn("place", F.row_number().over(order))
    return ranked.where(F.expr(f"place <= {spoilt} + 1")).select(*keys, "gram", "nth", "label")


def _meet_long(
    shorter: DataFrame, longer: DataFrame, keys: list[str], t: float, split: bool, pair: str
) -> DataFrame:
    """As ``_meet`` for pairs whose longer label has ``LONG`` characters or more."""
    same = shorter is longer
    one = cut(_grams(shorter, keys, t))
    two = one if same else cut(_grams(longer, keys, t))
    every = one if same else one.unionByName(two)
    counts = every.groupBy(*keys, "gram", "nth").agg(F.count(F.lit(1)).alias("often"))
    index, probe = _rarest(one, counts, keys, t), _rarest(two, counts, keys, t)
    on = [*keys, "gram", "nth"]
    if split:
        index, probe = _split_hot(cut(index), cut(probe), on)
        on = [*on, "c_index", "c_probe"]
    met = (
        index.withColumnRenamed("label", "b")
        .join(probe.withColumnRenamed("label", "a"), on)
        .selectExpr(*[f"`{k}`" for k in keys], "a", "b", "length(b) AS short", "length(a) AS long")
        .where(f"short <= long AND long >= {LONG} AND a <> b")
        .where(pair)
        .selectExpr("*", f"{_need(t)} AS need")
        .where("need <= short")
        .distinct()
    )
    return met.join(_with_masks(shorter).withColumnRenamed("label", "b"), [*keys, "b"])


def _blocks(
    labels: DataFrame, keys: list[str], t: float, probe: bool, carry: Sequence[str] | None = None
) -> DataFrame:
    """One row per label and block: ``short, long, i, part`` name the block besides ``keys``.

    Carried along are the columns named, else what scoring needs of the shorter label.
    """
    if _by_grams(t):
        labels = labels.where(F.length("label") < LONG)
    if probe:
        others = f"sequence(cast(ceil(length(label) * {t / (2 - t)!r}D - {SLACK!r}D) AS int), length(label))"
    else:
        others = f"sequence(length(label), cast(floor(length(label) * {(2 - t) / t!r}D + {SLACK!r}D) AS int))"
    extra = list(carry) if carry is not None else [] if probe else ["alphabet", "masks"]
    sized = (
        labels.select(*keys, "label", *extra, F.expr(f"explode({others}) AS other"))
        .selectExpr(
            *[f"`{k}`" for k in keys],
            "label",
            *extra,
            "least(length(label), other) AS short",
            "greatest(length(label), other) AS long",
        )
        .selectExpr("*", f"{_need(t)} AS need")
        .where("need <= short AND short > 0")
    )
    if _by_grams(t):
        sized = sized.where(F.col("long") < LONG)
    part = "named_struct('i', {i}, 'part', {text})"
    if probe:
        at = part.replace("{i}", "i").replace("{text}", f"substring(label, p, {_int(WIDTH, 'i')})")
        places = f"transform(sequence({_int(FIRST, 'i')}, {_int(LAST, 'i')}), p -> {at})"
        by_segment = f"flatten(transform(sequence(0, {PARTS} - 1), i -> {places}))"
        by_token = _tokens("label", "long - need + 1")
    else:
        cut_out = f"substring(label, {_int(START, 'i')}, {_int(WIDTH, 'i')})"
        at = part.replace("{i}", "i").replace("{text}", cut_out)
        by_segment = f"transform(sequence(0, {PARTS} - 1), i -> {at})"
        by_token = _tokens("label", "short - need + 1")
    at = part.replace("{i}", "-1").replace("{text}", "tok")
    found = f"CASE WHEN {PARTS} <= short THEN {by_segment} ELSE transform({by_token}, tok -> {at}) END"
    return sized.selectExpr(
        *[f"`{k}`" for k in keys],
        "short",
        "long",
        "need",
        "label",
        *extra,
        f"inline(array_distinct({found}))",
    )


def _first_shared() -> str:
    """True in the first of the blocks that the labels ``a`` (longer) and ``b`` share."""
    width = _int(WIDTH, "j")
    text = f"substring(b, {_int(START, 'j')}, {width})"
    first = _int(FIRST, "j")
    window = f"substring(a, {first}, {_int(LAST, 'j')} - {first} + {width})"
    met_before = f"exists(sequence(0, i), j -> j < i AND instr({window}, {text}) > 0)"
    shared = f"array_intersect({_tokens('b', 'short - need + 1')}, {_tokens('a', 'long - need + 1')})"
    return f"CASE WHEN i >= 0 THEN NOT {met_before} ELSE array_min({shared}) = part END"


def _split_hot(index: DataFrame, probe: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cut oversized blocks into chunks: each side is dealt out, and repeated per chunk of the other."""
    sizes = (
        index.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("n_index"))
        .join(probe.groupBy(*block).agg(F.count(F.lit(1)).alias("n_probe")), block)
        .where(F.col("n_index") * F.col("n_probe") > BLOCK_ROWS * BLOCK_ROWS)
        .select(
            *block,
            F.ceil(F.col("n_index") / BLOCK_ROWS).cast("int").alias("index_chunks"),
            F.ceil(F.col("n_probe") / BLOCK_ROWS).cast("int").alias("probe_chunks"),
        )
    )
    sizes = cut(sizes)

    def deal(side: DataFrame, own: str, other: str, own_chunk: str, other_chunk: str) -> DataFrame:
        marked = side.join(sizes, block, "left")
        mine = F.pmod(F.xxhash64("label"), F.coalesce(F.col(own), F.lit(1))).cast("int")
        repeat = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return marked.select(
            *side.columns, mine.alias(own_chunk), F.explode(repeat).alias(other_chunk)
        )

    return (
        deal(index, "index_chunks", "probe_chunks", "c_index", "c_probe"),
        deal(probe, "probe_chunks", "index_chunks", "c_probe", "c_index"),
    )


def _check(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return float(threshold)


def _with_masks(labels: DataFrame) -> DataFrame:
    return labels.selectExpr("*", f"{bit_alphabet('label')} AS alphabet", f"{bit_masks('label')} AS masks")


def _meet(
    shorter: DataFrame, longer: DataFrame, keys: list[str], t: float, split: bool, pair: str
) -> DataFrame:
    """``(keys..., a, b, similarity)``: ``a`` from ``longer``, ``b`` from ``shorter``."""
    index = _blocks(_with_masks(shorter), keys, t, probe=False)
    probe = _blocks(longer, keys, t, probe=True)
    on = [*keys, "short", "long", "i", "part"]
    if split:
        index, probe = _split_hot(index, probe, on)
        on = [*on, "c_index", "c_probe"]
    met = (
        index.withColumnRenamed("label", "b")
        .join(probe.drop("need").withColumnRenamed("label", "a"), on)
        .where(pair)
        .where(_first_shared())
    )
    named = [f"`{k}`" for k in keys]
    wanted = [*keys, "a", "b", "alphabet", "masks", "short", "long", "need"]
    met = met.select(*wanted)
    if _by_grams(t):
        met = met.unionByName(_meet_long(shorter, longer, keys, t, split, pair).select(*wanted))
    common = lcs_length("alphabet", "masks", "short", "a")
    scored = met.selectExpr(
        *named, "a", "b", "need", "short + long AS both", f"{common} AS common"
    ).where("common >= need")
    return scored.selectExpr(*named, "a", "b", "2.0D * common / both AS similarity")


def similar_pairs(
    labels: DataFrame, threshold: float = DEFAULT_THRESHOLD, keys: Sequence[str] = ()
) -> DataFrame:
    """``(keys..., a, b, similarity)`` for all pairs of different labels at or above the threshold.

    ``labels`` holds distinct ``(keys..., label)`` rows; pairs are formed within equal keys, and
    each unordered pair comes out once, ``a < b``. Empty labels are similar to nothing.
    """
    t, keys = _check(threshold), list(keys)
    # The table is read several times and may stand for a pass over all data.
    labels = cut(labels.select(*keys, "label").where(F.length("label") > 0))
    # A label is in a block at most once, so a small table cannot have oversized blocks.
    split = labels.count() > BLOCK_ROWS
    once = "short < long OR a > b"
    return _meet(labels, labels, keys, t, split, once).select(
        *keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"
    )


def pairs_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left, right, similarity)`` for the similar pairs across two disjoint label tables."""
    t = _check(threshold)
    left = left.select("label").where(F.length("label") > 0)
    right = right.select("label").where(F.length("label") > 0)
    split = right.count() > BLOCK_ROWS or left.count() > BLOCK_ROWS
    one = _meet(left, right, [], t, split, "true")
    two = _meet(right, left, [], t, split, "short < long")
    return one.select(F.col("b").alias("left"), F.col("a").alias("right"), "similarity").unionByName(
        two.select(F.col("a").alias("left"), F.col("b").alias("right"), "similarity")
    )


def near_duplicates(
    df: DataFrame, columns: Sequence[str], threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """``(column, value_a, value_b, similarity)``: labels that differ by more than case, but little.

    Compares lower-cased labels; labels equal but for case are no pair. ``value_a < value_b``.
    """
    require(df, *columns)
    labels = cut(melt(df, columns, "string").distinct())
    low = labels.withColumn("label", F.lower("value"))
    pairs = similar_pairs(low.select("column", "label").distinct(), threshold, ["column"])
    side = lambda n, v: low.select("column", F.col("label").alias(n), F.col("value").alias(v))
    both = pairs.join(side("a", "x"), ["column", "a"]).join(side("b", "y"), ["column", "b"])
    return both.select(
        "column",
        F.least("x", "y").alias("value_a"),
        F.greatest("x", "y").alias("value_b"),
        F.round("similarity", 3).alias("similarity"),
    )


BLOCK = ["short", "long", "i", "part"]
AS_INDEX, AS_PROBE = 1, 2


def _block_rows(ranked: DataFrame, t: float) -> DataFrame:
    """``(label, rank, role)`` and the block: every block in which a label can meet a similar one.

    Labels met over pairs of characters play both roles in such a block.
    """
    carried = ["rank"]
    index = _blocks(ranked, [], t, probe=False, carry=carried).withColumn("role", F.lit(AS_INDEX))
    probe = _blocks(ranked, [], t, probe=True, carry=carried).withColumn("role", F.lit(AS_PROBE))
    wanted = [*BLOCK, "label", "rank", "role"]
    rows = index.select(*wanted).unionByName(probe.select(*wanted))
    if not _by_grams(t):
        return rows
    grams = cut(_grams(ranked, [], t))
    counts = grams.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("often"))
    long = _rarest(grams, counts, [], t).join(ranked, "label")
    return rows.unionByName(
        long.selectExpr("-1 AS short", "-1 AS long", "cast(nth AS int) AS i", "gram AS part", "label", "rank", f"{AS_INDEX | AS_PROBE} AS role")
    )


def _first_pairs(rows: DataFrame, t: float, first: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Similar pairs ``(early, late)`` among the first labels of each block, and the labels that are not
    among the first in some block, so that earlier ones may be similar to them unseen; None where there is
    none, so that these are all pairs. Without ``first`` all of each block are looked at."""
    near, unsure = rows, None
    if first is not None:
        order = Window.partitionBy(*BLOCK).orderBy("rank")
        ahead = cut(rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= first + 1))
        bounds = ahead.where(F.col("place") == first + 1).select(*BLOCK, F.col("rank").alias("bound")).distinct()
        unsure = cut(rows.join(bounds, BLOCK).where(F.col("rank") >= F.col("bound")).select("label").distinct())
        unsure = None if unsure.isEmpty() else unsure
        near = ahead.where(F.col("place") <= first)

    def side(role: int, label: str, rank: str) -> DataFrame:
        return near.where(F.col("role").bitwiseAND(role) > 0).select(*BLOCK, F.col("label").alias(label), F.col("rank").alias(rank))

    met = (
        side(AS_INDEX, "b", "rank_b")
        .join(side(AS_PROBE, "a", "rank_a"), BLOCK)
        .selectExpr("a", "b", "rank_a < rank_b AS forward", "length(b) AS short", "length(a) AS long")
        .where("short < long OR (short = long AND a > b)")
        .selectExpr("*", f"{_need(t)} AS need")
        .where("need <= short")
        .distinct()
    )
    met = met.selectExpr("*", f"{bit_alphabet('b')} AS alphabet", f"{bit_masks('b')} AS masks")
    met = met.where(f"{lcs_length('alphabet', 'masks', 'short', 'a')} >= need")
    return cut(met.selectExpr("if(forward, a, b) AS early", "if(forward, b, a) AS late").distinct()), unsure


def _leaders(ranked: DataFrame, t: float, first: int | None) -> tuple[DataFrame, DataFrame | None]:
    """``(label, rank)`` of the labels that surely lead, judged by the first labels of each block, and all similar pairs if
    those were all.

    One that is among the first in all its blocks has all its earlier similar labels in ``edges``. It leads once those
    are claimed. The earliest label of all is always such a one.
    """
    edges, unsure = _first_pairs(_block_rows(ranked, t), t, first)
    waiting = ranked if unsure is None else ranked.join(unsure, "label", "left_anti")
    found, left = None, edges
    while True:
        behind = left.select(F.col("late").alias("label")).distinct()
        new = waiting.join(behind, "label", "left_anti")
        found = new if found is None else found.unionByName(new)
        claimed = cut(left.join(new.select(F.col("label").alias("early")), "early", "left_semi").select("late").distinct())
        if claimed.isEmpty():
            return cut(found), edges if unsure is None else None
        gone = claimed.select(F.col("late").alias("label"))
        waiting = cut(waiting.join(behind, "label", "left_semi").join(gone, "label", "left_anti"))
        left = cut(left.join(claimed, "late", "left_anti").join(claimed.withColumnRenamed("late", "early"), "early", "left_anti"))


def _reached(leaders: DataFrame, others: DataFrame, t: float, edges: DataFrame | None = None) -> DataFrame:
    """``(label, canonical, rank)``: the labels similar to a leader, with the earliest such leader. ``edges`` are all pairs, if known."""
    if edges is not None:
        pairs = edges.select(F.col("early").alias("left"), F.col("late").alias("right"))
    else:
        pairs = pairs_between(leaders, others, t)
    pairs = pairs.join(leaders.withColumnRenamed("label", "left"), "left")
    return pairs.groupBy(F.col("right").alias("label")).agg(F.min_by("left", "rank").alias("canonical"), F.min("rank").alias("rank"))


def greedy_merge(ranked: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(label, canonical)`` for every label that is merged into an earlier one.

    ``ranked`` holds distinct ``(label, rank)`` rows with a total order in ``rank``. Walking the
    labels in that order, one that is not yet claimed leads, and claims all similar labels that
    nobody has claimed; claims are not chained. Similarity being symmetric, the leaders are the
    lexicographically first maximal independent set of the similarity graph, and a label belongs
    to the earliest leader next to it. Rounds find them in parallel (Blelloch et al., 2012).

    A family of similar labels may hold a large part of a big table, and its pairs alone would be
    quadratic. So a round looks at the first ``AHEAD`` labels of each block only, settles what they decide, and lets
    the new leaders claim what they reach among all; families vanish from the blocks with their leaders. The
    prefix grows fourfold from round to round, so what stays in a block are labels that truly are
    not similar. Pairs of two members outside these prefixes are never made.
    """
    t = _check(threshold)
    rest = cut(ranked.select("label", "rank"))
    first, found, claims = AHEAD, [], []
    left = rest.count()
    while left:
        leaders, edges = _leaders(rest, t, first if left > SMALL else None)
        others = rest.join(leaders, "label", "left_anti")
        reached = cut(_reached(leaders, others, t, edges))
        found.append(leaders)
        claims.append(reached)
        if edges is not None:  # nothing is undecided
            break
        rest = cut(others.select("label", "rank").join(reached, "label", "left_anti"))
        left = rest.count()
        first *= 4
    mapping = ranked.selectExpr("label", "label AS canonical", "rank").limit(0)
    for claim in claims:
        mapping = mapping.unionByName(claim)
    if len(found) > 1:  # a label that was claimed may be next to a still earlier leader found after it
        later = found[1]
        for leaders in found[2:]:
            later = later.unionByName(leaders)
        before = claims[0]
        for claim in claims[1:-1]:
            before = before.unionByName(claim)
        mapping = mapping.unionByName(_reached(cut(later), cut(before.select("label")), t))
    return mapping.groupBy("label").agg(F.min_by("canonical", "rank").alias("canonical"))


def label_mapping(
    df: DataFrame,
    column: str,
    threshold: float = DEFAULT_THRESHOLD,
    order_by: str | None = None,
) -> DataFrame:
    """``(label, canonical)`` over the clean forms of a column's labels.

    Rows have no order in Spark: the label seen first is the one with the smallest ``order_by``
    value; without ``order_by`` the more frequent label comes first. Ties go to the smaller text.
    """
    label = clean_label(ref(column)).alias("label")
    if order_by is None:
        first = F.count(F.lit(1)) * F.lit(-1)
        source = df.select(label)
    else:
        first = F.min("seen")
        source = df.select(label, ref(order_by).alias("seen"))
    ranked = (
        source.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(first.alias("first"))
        .select("label", F.struct("first", "label").alias("rank"))
    )
    return greedy_merge(ranked, threshold)
