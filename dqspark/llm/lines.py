"""Removal of repeated three-line windows.

Every run of three consecutive lines is hashed; windows found more than once in the corpus are
kept where they stand first, in the order of (doc_id, line), and the lines of all their later
occurrences are removed. Counting is a combined aggregation; only windows that repeat are joined
back, and only line numbers travel to the documents, never their text between documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import WORD_CHAR, row_keys


def line_windows(docs: DataFrame) -> DataFrame:
    """One row per window: the document's keys and id, the number of the first line, two hashes.

    A window without a single word character is none.
    """
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), docs["doc_id"].alias("id"), F.split(docs["text"], "\n").alias("l"))
    rows = rows.where(F.size("l") >= 3)
    said = WORD_CHAR.replace("\\", "\\\\")  # within a SQL string
    windows = F.expr(
        "transform(sequence(0, size(l) - 3), i -> struct(i AS at,"
        " xxhash64(l[i], l[i + 1], l[i + 2]) AS h1, xxhash64('w', l[i + 2], l[i + 1], l[i]) AS h2,"
        rf" l[i] RLIKE '{said}' OR l[i + 1] RLIKE '{said}' OR l[i + 2] RLIKE '{said}' AS said))"
    )
    return rows.select("k1", "k2", "id", F.inline(windows)).where("said").drop("said")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Per document with any: its keys and the first lines of its later occurrences."""
    every = line_windows(docs)
    place = F.struct(F.col("id").isNull(), "id", "k1", "k2", "at")
    repeated = (
        every.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = every.join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("k1", "k2").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``row`` (their columns as they were), ``kept_text``, ``n_lines``,
    ``n_removed`` and ``n_spans`` (maximal runs of removed lines).

    NULL texts stay NULL and have no lines; an empty text has one empty line. Lines are split at
    ``\\n`` alone. A text with fewer than three lines has no window. Rows with the same doc_id and
    text count as one document, so such copies come out alike; NULL ids come last in order. An
    empty table gives an empty one; other columns may have any names.
    """
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(repeated_lines(docs), ["k1", "k2"], "left")
    joined = joined.select("row", "starts", F.split("row.text", "\n").alias("lines"))
    covered = F.expr(
        "coalesce(array_sort(array_distinct(concat(starts, transform(starts, x -> x + 1),"
        " transform(starts, x -> x + 2)))), cast(array() AS array<int>))"
    )
    joined = joined.select("row", "lines", covered.alias("gone"))
    kept = F.expr("transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])")
    return joined.select(
        "row",
        F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_removed"),
        F.expr("size(filter(gone, (x, i) -> i = 0 OR gone[i - 1] < x - 1))").cast("bigint").alias("n_spans"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines removed, ``n_chars`` counted anew where it exists."""
    out = dedup_lines(docs)
    cells = []
    for c in docs.columns:
        if c == "text":
            cells.append(F.col("kept_text").alias("text"))
        elif c == "n_chars":
            cells.append(F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            cells.append(F.col("row")[c].alias(c))
    return out.select(*cells)
