"""Label similarity, merging, and joins against reference lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import dirt, query
from dqspark.functions.text import label_similarity
from dqspark.operators.clean import clean
from dqspark.operators.similarity import label_mapping, near_duplicates
from dqspark.operators.tables import accepted_by_reference, rejected_by_reference

@query(
    "near_duplicates",
    f"""WITH RECURSIVE labels_ AS (
    SELECT DISTINCT 'p_brand' AS "column", p_brand AS value FROM part
    UNION ALL SELECT DISTINCT 'p_name', p_name FROM part
    UNION ALL SELECT DISTINCT 'p_type', p_type FROM part),
  {dirt.PAIRS}, {dirt.LCS} {dirt.NEAR}""",
)
def near_duplicate_labels(spark, sf_dir):
    return near_duplicates(dirt.table(spark, sf_dir, "part"), ["p_brand", "p_name", "p_type"])


@query(
    "near_duplicates_case",
    f"""WITH RECURSIVE {dirt.EVENTS}, labels_ AS (SELECT DISTINCT 'event_type' AS "column",
    event_type AS value FROM e WHERE event_type IS NOT NULL),
  {dirt.PAIRS}, {dirt.LCS} {dirt.NEAR}""",
)
def near_duplicate_spellings(spark, sf_dir):
    return near_duplicates(dirt.events(spark, sf_dir), ["event_type"])


@query(
    "label_similarity",
    f"""WITH RECURSIVE p AS (SELECT DISTINCT o_orderpriority AS a, p_type AS b FROM (
    SELECT *, o_orderkey % (SELECT count(*) FROM part) + 1 AS k FROM orders) x
    JOIN part ON p_partkey = k),
  {dirt.LCS} SELECT a AS label_a, b AS label_b, round(similarity, 4) AS similarity FROM sim""",
)
def similarity_of_labels(spark, sf_dir):
    parts = dirt.table(spark, sf_dir, "part")
    n = parts.count()
    orders = dirt.table(spark, sf_dir, "orders").withColumn("p_partkey", F.col("o_orderkey") % n + 1)
    pairs = orders.join(parts, "p_partkey").select(
        F.col("o_orderpriority").alias("label_a"), F.col("p_type").alias("label_b")
    )
    scored = pairs.distinct().withColumn("similarity", label_similarity("label_a", "label_b"))
    return scored.withColumn("similarity", F.round("similarity", 4))


# Labels in rank order; one is a leader unless an earlier leader is similar. With few labels the
# greedy walk is one recursion step per label.
MERGE = """ranked AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS rank FROM (
    SELECT label, count(*) AS n FROM clean_ WHERE label IS NOT NULL GROUP BY label)),
  p AS (SELECT l.label AS a, r.label AS b FROM ranked l JOIN ranked r ON l.rank < r.rank),
  {LCS},
  near AS (SELECT x.rank AS early, y.rank AS late FROM sim JOIN ranked x ON x.label = a
    JOIN ranked y ON y.label = b WHERE similarity >= 0.85 - 1e-9),
  late_ AS (SELECT rank, list(early ORDER BY early) FILTER (early IS NOT NULL) AS earlier
    FROM ranked LEFT JOIN near ON late = rank GROUP BY rank),
  greedy AS (SELECT 0::BIGINT AS rank, []::BIGINT[] AS leaders, NULL::BIGINT AS leader
    UNION ALL
    SELECT l.rank, CASE WHEN len(list_intersect(coalesce(earlier, []), leaders)) = 0
        THEN list_append(leaders, l.rank) ELSE leaders END,
      CASE WHEN len(list_intersect(coalesce(earlier, []), leaders)) = 0 THEN NULL
        ELSE list_min(list_intersect(earlier, leaders)) END
    FROM greedy g JOIN late_ l ON l.rank = g.rank + 1),
  mapping AS (SELECT m.label AS label, c.label AS canonical FROM greedy g
    JOIN ranked m ON m.rank = g.rank JOIN ranked c ON c.rank = g.leader)""".replace("{LCS}", dirt.LCS)
CLEAN = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


@query(
    "label_mapping",
    f"""WITH RECURSIVE clean_ AS (SELECT {CLEAN.replace('{c}', 'p_name')} AS label FROM part), {MERGE}
SELECT label, canonical FROM mapping""",
)
def merged_labels(spark, sf_dir):
    return label_mapping(dirt.table(spark, sf_dir, "part"), "p_name")


@query(
    "standardize_labels",
    f"""WITH RECURSIVE clean_ AS (SELECT p_partkey, {CLEAN.replace('{c}', 'p_brand')} AS label FROM part),
  {MERGE} SELECT p_partkey, coalesce(canonical, c.label) AS p_brand
FROM clean_ c LEFT JOIN mapping m ON m.label = c.label""",
)
def standardize_labels(spark, sf_dir):
    out = clean(dirt.table(spark, sf_dir, "part"), "p_brand", "standardize_categories")
    return out.select("p_partkey", "p_brand")


@query(
    "standardize_spellings",
    f"""WITH RECURSIVE {dirt.EVENTS}, clean_ AS (SELECT event_id,
    {CLEAN.replace('{c}', 'event_type')} AS label FROM e),
  {MERGE} SELECT event_id, coalesce(canonical, c.label) AS event_type
FROM clean_ c LEFT JOIN mapping m ON m.label = c.label""",
)
def standardize_spellings(spark, sf_dir):
    out = clean(dirt.events(spark, sf_dir), "event_type", "standardize_categories")
    return out.select("event_id", "event_type")


@query(
    "reference_known",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def reference_known(spark, sf_dir):
    known = dirt.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "BUILDING")
    found = accepted_by_reference(dirt.table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey")
    return found.select("o_custkey", "o_orderkey")


@query(
    "reference_unknown",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (
  SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def reference_unknown(spark, sf_dir):
    known = dirt.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "BUILDING")
    found = rejected_by_reference(dirt.table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey")
    return found.select("o_custkey", "o_orderkey")
