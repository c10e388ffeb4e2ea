"""The registered queries of this package and the SQL beside them, where SQL can express one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import urls
from dqspark.llm.divergence import audit_sources
from dqspark.llm.kdtree import top_k
from dqspark.llm.lines import dedup_lines
from dqspark.llm.mixing import mix
from dqspark.llm.packing import pack
from dqspark.llm.quality import BASE, quality_rules
from dqspark.llm.secrets import scan_secrets, told
from dqspark.llm.simhash import simhash_components
from dqspark.llm.spans import align_tokens
from dqspark.llm.substrings import remove_repeats
from dqspark.llm.tokens import token_counts
from dqspark.llm.toxicity import judge_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file; the folder may be named by TOKENIZERS_DIR."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", *BASE, "base_failed", "kept", "votes", F.round("p_good", 6).alias("p_good"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(l) - 1)) AS pos, l FROM d WHERE len(l) >= 3
),
x AS (
  SELECT doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS t FROM w
),
y AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k
  FROM x WHERE regexp_matches(t, '[^\x20\x09-\x0D]')
),
gone AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM y WHERE k > 1
),
lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d
),
marked AS (
  SELECT lines.doc_id, lines.pos, line, gone.pos IS NOT NULL AS cut,
         coalesce(lag(gone.pos IS NOT NULL) OVER (PARTITION BY lines.doc_id ORDER BY lines.pos), false) AS before
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.pos = lines.pos
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
       count(*) FILTER (WHERE cut AND NOT before) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_secret_scans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


@query("op5_url_filters", urls.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


@query("op9_exact_top_k", TOP_K_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=50)


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
l AS MATERIALIZED (
  SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM l GROUP BY lang),
k AS MATERIALIZED (
  SELECT g.lang, g.source, l.term, l.c AS lc, coalesce(x.c, 0)::HUGEINT AS c
  FROM g JOIN l ON g.lang = l.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.term = l.term
),
t AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM k GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT k.lang, k.source, k.term, k.c, 1 + 1000000000 * (k.c + 2) // (t.n + 2 * v.v)::HUGEINT AS p,
         1 + 1000000000 * (k.lc + 2) // (v.n + 2 * v.v)::HUGEINT AS q
  FROM k JOIN t ON t.lang = k.lang AND t.source = k.source JOIN v ON v.lang = k.lang
),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
