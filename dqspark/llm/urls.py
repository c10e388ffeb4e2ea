"""URL filters: rules by host and path, and trust and distrust that spread over links between hosts.

A page that a rule fits is judged by it. For the others the hosts vote: hosts whose pages are mostly
allowed by rules are trusted, hosts whose pages are mostly blocked are distrusted. Trust follows links (personalised
PageRank from the trusted hosts); distrust runs against them, to hosts that link to blocked ones. Ranks
are whole numbers, so every run gives the same result in whatever order they are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import written

#: Host (with all its subdomains) and path prefix, and what the rule says.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Absolute and protocol-relative links in HTML; the group is the host.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: The mass of rank given out, the share of it that follows links (a ratio), and the rounds between two tables.
MASS, FOLLOW, OF, ROUNDS = 10**12, 85, 100, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def host_and_path(pages: DataFrame, *others: str) -> DataFrame:
    """``page_id``, ``host``, ``path`` and other columns."""
    at = F.instr(pages["url"], "://")
    rest = F.when(at > 0, F.substring(pages["url"], at + 3, F.length(pages["url"]))).otherwise("")
    df = pages.select(pages["page_id"].alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest"), *[pages[c].alias(c) for c in others])
    return df.select(
        "page_id",
        lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*(/[^?#]*)", 1).alias("path"),
        *others,
    )


def fitting_rule() -> Column:
    """The longest rule that fits ``host`` and ``path``, as an array of the rule and what it says."""
    case = None
    for rule, says in sorted(RULES, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        then = F.struct(F.lit(rule).alias("rule"), F.lit(says).alias("says"))
        case = F.when(fits, then) if case is None else case.when(fits, then)
    return case


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: ``src``, ``dst`` and ``n``."""
    found = host_and_path(pages, "html").where("host <> ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")
    )
    found = found.select("src", lower(F.col("dst")).alias("dst")).where("src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` of every host in edges or seeds.

    ``seeds``: ``host``, ``trusted``, ``blocked`` (weights). Each kind of seed shares ``MASS`` by weight;
    each round a host passes ``FOLLOW`` / ``OF`` of its trust to the hosts it links to and of its
    distrust to those that link to it, by number of links. All start from nothing, so ranks only grow, and, being
    whole numbers below ``MASS``, come to rest; rounds go on until they do. What is passed over one more link shrinks by
    ``FOLLOW`` / ``OF``, so that takes some 170 rounds where links go on so far, and few where they do not.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    moves = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), "n", "total", F.lit(True).alias("along"))
    moves = moves.union(
        edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), "n", "total", F.lit(False))
    )
    moves = written(moves, "moves")
    sums = seeds.agg(F.greatest(F.sum("trusted"), F.lit(1)), F.greatest(F.sum("blocked"), F.lit(1))).collect()[0]
    given = [F.expr(f"cast({c} * {MASS}BD DIV {s or 1} AS bigint)").alias(c) for c, s in zip(("trusted", "blocked"), sums)]
    named = seeds.select("host", *given).union(edges.select("src", F.lit(0), F.lit(0))).union(edges.select("dst", F.lit(0), F.lit(0)))
    start = named.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked"))
    zero = F.lit(0).cast("bigint")
    state = start.select("*", zero.alias("trust"), zero.alias("distrust"))
    while True:
        for _ in range(ROUNDS):
            passed = "cast(cast({0} AS decimal(38,0)) * n DIV total AS bigint)"
            sent = state.join(moves, "host").groupBy(F.col("to").alias("host")).agg(
                F.sum(F.expr(f"if(along, {passed.format('trust')}, 0L)")).alias("got_trust"),
                F.sum(F.expr(f"if(along, 0L, {passed.format('distrust')})")).alias("got_distrust"),
            )
            rank = "cast(({0} * {1} + coalesce({2}, 0L) * {3}) DIV {4} AS bigint)"
            now = state.join(sent, "host", "left").select(
                "host", "trusted", "blocked",
                F.expr(rank.format("trusted", OF - FOLLOW, "got_trust", FOLLOW, OF)).alias("trust"),
                F.expr(rank.format("blocked", OF - FOLLOW, "got_distrust", FOLLOW, OF)).alias("distrust"),
                F.col("trust").alias("was_trust"), F.col("distrust").alias("was_distrust"),
            )
            state = now.drop("was_trust", "was_distrust")
        now = written(now, "ranks")
        state = now.drop("was_trust", "was_distrust")
        if now.where("trust <> was_trust OR distrust <> was_distrust").isEmpty():
            break
    return state.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    Without a fitting rule a page is blocked where its host has more distrust than trust, else
    allowed; so are pages without a host. NULL urls, and such without ``://``, have neither host nor
    path; NULL html has no links. Rows with NULL or repeated page_ids are judged each; an
    empty table gives an empty one; other columns are not read.
    """
    judged = host_and_path(pages).select("page_id", "host", "path", fitting_rule().alias("fit"))
    judged = judged.select("page_id", "host", "path", "fit.rule", "fit.says")
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.expr("says = 'allow'")).alias("allowed"), F.count_if(F.expr("says = 'block'")).alias("blocked")
    )
    seeds = seeds.select(
        "host", F.expr("if(2 * allowed > n, allowed, 0)").alias("trusted"), F.expr("if(2 * blocked > n, blocked, 0)").alias("blocked")
    )
    placed = ranks(written(host_edges(pages), "edges"), written(seeds, "seeds"))
    distrusted = placed.where("distrust > trust").select("host", F.lit("block").alias("voted"))
    verdict = F.coalesce("says", "voted", F.lit("allow"))
    return judged.join(distrusted, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same in SQL, its rounds as a recursion that ends when no rank changes."""
    cases = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for h, _, p in (r.partition("/") for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
    )
    says = " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in RULES)
    link = LINK.replace("'", "''")
    keep = OF - FOLLOW
    return rf"""
WITH RECURSIVE r AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM r
),
j AS (
  SELECT *, CASE rule {says} END AS says FROM (SELECT *, CASE
{cases}
    END AS rule FROM h)
),
seeds AS (
  SELECT host, CASE WHEN 2 * a > n THEN a ELSE 0 END AS tr, CASE WHEN 2 * b > n THEN b ELSE 0 END AS bl
  FROM (SELECT host, count(*) AS n, count(*) FILTER (WHERE says = 'allow') AS a, count(*) FILTER (WHERE says = 'block') AS b
        FROM j WHERE host <> '' GROUP BY host)
),
edges AS MATERIALIZED (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM h WHERE host <> ''
  ) WHERE src <> dst GROUP BY src, dst
),
outs AS (SELECT src, sum(n) AS total FROM edges GROUP BY src),
backs AS (SELECT dst, sum(n) AS total FROM edges GROUP BY dst),
start AS MATERIALIZED (
  SELECT host, max(tr) AS trusted, max(bl) AS blocked FROM (
    SELECT host, CAST(tr::HUGEINT * {MASS} // greatest(1, (SELECT sum(tr) FROM seeds)) AS BIGINT) AS tr,
           CAST(bl::HUGEINT * {MASS} // greatest(1, (SELECT sum(bl) FROM seeds)) AS BIGINT) AS bl FROM seeds
    UNION ALL SELECT src, 0, 0 FROM edges UNION ALL SELECT dst, 0, 0 FROM edges
  ) GROUP BY host
),
moves AS MATERIALIZED (
  SELECT src AS host, dst AS onto, n, total, true AS along FROM edges JOIN outs USING (src)
  UNION ALL SELECT dst, src, n, total, false FROM edges JOIN backs USING (dst)
),
s AS (
  SELECT 0 AS i, host, trusted, blocked, 0::BIGINT AS trust, 0::BIGINT AS distrust, true AS moved FROM start
  UNION ALL
  SELECT i + 1, host, trusted, blocked, new_trust, new_distrust, new_trust <> trust OR new_distrust <> distrust FROM (
    SELECT s.*, CAST((trusted * {keep} + coalesce(t, 0) * {FOLLOW}) // {OF} AS BIGINT) AS new_trust,
           CAST((blocked * {keep} + coalesce(b, 0) * {FOLLOW}) // {OF} AS BIGINT) AS new_distrust
    FROM s LEFT JOIN (
      SELECT onto, sum(CASE WHEN along THEN trust::HUGEINT * n // total ELSE 0 END) AS t,
             sum(CASE WHEN along THEN 0 ELSE distrust::HUGEINT * n // total END) AS b
      FROM s JOIN moves USING (host) GROUP BY onto
    ) ON onto = s.host
    WHERE (SELECT bool_or(moved) FROM s)
  )
),
last AS (SELECT host, trust, distrust FROM s WHERE i = (SELECT max(i) FROM s))
SELECT page_id, j.host, path, rule,
       coalesce(says, CASE WHEN distrust > trust THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN last s ON j.host = s.host
"""
