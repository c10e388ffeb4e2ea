"""Divergence of sources from each other and from their language, by ranking cells of counts.

What a term adds to a divergence depends on two counts alone: terms that share both form a cell. So the
divergence is evaluated once per cell, not per term: cells of a group are ranked by it, those of equal value are
merged, and the running total of their terms tells which values reach the first ranks; only terms in
those cells are expanded and put in the order of their UTF-8 bytes. Between two sources a cell is made of
all terms of a language whose shares agree in every source.

All numbers are whole: a term's share in a group is 1 + floor(10^9 * (count + 2) / (N + 2 * V)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import ship, written

#: Documents of a language that must hold a term; ranks of terms that are reported; the scale of shares.
LEAST_DOCUMENTS, RANKS, SCALE = 10, 10, 10**9
#: Bytes of text counted at a time, and entries a worker holds before it hands them on.
CHUNK, HELD = 1 << 20, 200_000
#: Terms are runs of ASCII letters and of all that is not ASCII; A-Z become lower case, other bytes blanks.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order; a long text comes in parts cut between terms."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= CHUNK else folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents that hold it), added up
    within each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*((lang, source, len(total), total, inside) for (lang, source), (total, inside) in held.items()))
            langs, sources, sizes, totals, insides = columns
            each = np.repeat(np.arange(len(sizes)), sizes)
            arrays = [pa.array(c, pa.string()).take(pa.array(each)) for c in (langs, sources)]
            arrays.append(pa.array([t for total in totals for t in total], pa.binary()))
            # both counters met the terms in the same order
            arrays += [pa.array([n for c in counters for n in c.values()], pa.int64()) for counters in (totals, insides)]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen: dict[bytes, None] = {}
                for part in terms(text):
                    if part:
                        if (lang, source) not in held:
                            held[lang, source] = Counter(), Counter()
                        seen.update(dict.fromkeys(part))
                        held[lang, source][0].update(part)
                if seen:
                    held[lang, source][1].update(seen.keys())
            if sum(len(t) for t, _ in held.values()) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    ship(docs.sparkSession)
    blank = F.lit("")
    rows = docs.select(
        F.coalesce(docs["lang"], blank).alias("lang"),
        F.coalesce(docs["source"], blank).alias("source"),
        F.coalesce(docs["text"], blank).cast("binary").alias("text"),
    )
    found = rows.mapInArrow(count, "lang string, source string, term binary, n bigint, docs bigint")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.withColumn("term", F.col("term").cast("string"))


def share(count: str, total: str) -> str:
    """The share of a term in a group, of which ``total`` is N + 2 * V; decimals hold every product."""
    return f"1 + (cast({SCALE} AS decimal(38,0)) * ({count} + 2)) DIV ({total})"


def divergence(p: str, q: str) -> str:
    """What a term adds: shares are at most 10^9 + 1, so that the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def pair_sums(cells: DataFrame) -> DataFrame:
    """``lang``, ``i``, ``j`` and the summed divergence of sources ``i`` < ``j`` (places in the language's list).

    ``cells``: ``lang``, ``shares`` (one per source) and ``many``, the terms with these shares. Each batch of cells
    gives one row per source and language, which are then added up.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            many = batch.column(2).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs.tolist())):
                own = np.flatnonzero(langs == lang)
                p = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for i in range(p.shape[1] - 1):
                    a, b = p[:, i : i + 1], p[:, i + 1 :]
                    sums = many[own] @ ((a - b) * (a - b) // (a + b))
                    columns = [pa.array([lang]), pa.array([i], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "i", "sums"])

    rows = cells.select("lang", "shares", "many").mapInArrow(add, "lang string, i int, sums array<bigint>")
    rows = rows.select("lang", "i", F.posexplode("sums").alias("j", "value")).withColumn("j", F.expr("i + 1 + j"))
    return rows.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair`` tells how far each other source of the language is from a source, summed over all kept terms;
    part ``term`` the ``RANKS`` terms that mark a source most against its language. Kept are the terms in at least
    ``LEAST_DOCUMENTS`` documents of the language. NULL lang, source and text count as empty; empty
    texts have no terms, but their group occurs. A language without kept terms has pairs of value 0.
    Ties are ranked by the item's UTF-8 bytes. Repeated rows, with equal or NULL ids too, are documents each; an empty table gives
    an empty one; other columns are not read. A worker holds the terms of one batch of documents and, between sources, one batch of cells.
    """
    blank = F.lit("")
    counts = written(counted(docs), "term-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = of_lang.where(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "lang_n")
    kept = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    groups = docs.select(F.coalesce(docs["lang"], blank).alias("lang"), F.coalesce(docs["source"], blank).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    langs = kept.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = written(groups.join(langs, "lang", "left").na.fill(0, ["v", "lang_total"]), "groups")
    whole, lang_whole = "cast(total AS decimal(38,0)) + 2 * v", "cast(lang_total AS decimal(38,0)) + 2 * v"

    # part term: cells of (count in the group, count in the language)
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("many")).join(groups, ["lang", "source"])
    cells = cells.withColumn("p", F.expr(share("n", whole))).withColumn("q", F.expr(share("lang_n", lang_whole)))
    cells = cells.where("p > q").withColumn("value", F.expr(divergence("p", "q")))
    cells = written(cells.select("lang", "source", "n", "lang_n", "many", "value"), "cells")
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # every value has a term at least, so the first ranks lie within as many values
    merged = merged.withColumn("place", F.row_number().over(down)).where(F.col("place") <= RANKS)
    before = F.coalesce(F.sum("many").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    merged = merged.withColumn("before", before).where(F.col("before") < RANKS).select("lang", "source", "value")
    best = cells.join(merged, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    expanded = kept.join(best, ["lang", "source", "n", "lang_n"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    expanded = expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    term_part = expanded.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # part pair: cells of the shares in all sources of the language
    base = groups.where("v > 0").withColumn("base", F.expr(share("0", whole)))
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    bases = base.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "base"))).alias("bases"))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", F.expr(share("n", whole)).alias("p"))
    sparse = shares.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "p"))).alias("p"))
    dense = sparse.join(bases, "lang").select("lang", F.expr("transform(bases, b -> coalesce(p[b.source], b.base))").alias("shares"))
    sums = pair_sums(dense.groupBy("lang", "shares").agg(F.count("*").alias("many")))
    pairs = lists.select("lang", "sources", F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("a"))
    pairs = pairs.select("lang", "sources", "a", F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("b")).where("a <> b")
    pairs = pairs.select("lang", F.expr("sources[a]").alias("source"), F.expr("sources[b]").alias("item"), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").na.fill(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_part = pairs.withColumn("rank", F.row_number().over(order))
    return pair_part.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(term_part)
