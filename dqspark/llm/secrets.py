"""Secrets in texts: named patterns, and a battery of randomness tests for strings without a name.

A part of a run of encoded characters that no pattern covers is flagged if it looks drawn at random from its
encoding's alphabet (chi-squared test of uniform symbols, runs test, serial correlation: none may
reject) and if ordinary writing is rejected as its origin. That rejection rests on how seldom two of its
symbols agree; the longer the string, the smaller its p-value can get. Over the whole corpus the
Benjamini-Hochberg procedure, within each band of lengths, bounds the share of false flags. All of it
is DataFrame expressions; the procedure needs only counts of p-values by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import row_keys, written

KINDS = ("assign", "access", "hex", "random")
# fixed values: the patterns that must be matched
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Stands for the characters of a base span where runs are looked for.
MASK = "\x01"
#: Runs that the battery looks at; what a base span leaves of a run may be as short as a part.
RUN = r"[A-Za-z0-9+/=_-]{20,}|(?<=\x01)[A-Za-z0-9+/=_-]{16,}|[A-Za-z0-9+/=_-]{16,}(?=\x01)"
#: Parts of a run: between the '=' inside it; where such a part fits no encoding, by alphabet.
PART = r"[A-Za-z0-9+/_-]{16,}(?:=+$)?"
FITS = r"^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
NARROW = (r"[A-Za-z0-9+/]{16,}(?:=+$)?", r"[A-Za-z0-9_-]{16,}(?:=+$)?")
#: Encoding, pattern of the whole string, alphabet, chance that two symbols of ordinary writing in it agree.
ENCODINGS = (
    ("hex", "^([0-9]*[a-f]+[0-9a-f]*|[0-9]*[A-F]+[0-9A-F]*)$", "0123456789abcdef", 0.125),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.068),
    ("base36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.068),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.062),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.062),
)
#: A test that finds less than this rejects randomness; the share of false flags among the flagged.
LEVEL, FALSE_SHARE = 0.01, 0.05
#: P-values are counted by their logarithm in steps of 1 / STEPS.
STEPS = 20
NO_SPANS = "cast(array() AS array<struct<start:int,stop:int>>)"


def spans_of(text: str, pattern: str, group: str | None = None, least: int = 0) -> Column:
    """Start and end of every match, leftmost first; those whose group is shorter than ``least`` go.

    Lengths of what lies between the matches and of the matches are summed up by doubling, so a
    text of n matches takes n log n steps.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    size = f"transform(regexp_extract_all({text}, '{p}', 0), x -> length(x))"
    kept = f"transform(regexp_extract_all({text}, '{p}', {group or 0}), x -> length(x))"
    gap = f"transform(split({text}, '{p}', -1), x -> length(x))"
    step = "shiftleft(1, k)"
    ends = (
        "aggregate(sequence(0, cast(ceil(log2(size(z) + 1)) AS int)), transform(z, x -> x.gap + x.size),"
        f" (a, k) -> transform(a, (x, i) -> x + if(i >= {step}, get(a, i - {step}), 0)))"
    )
    found = (
        f"filter(zip_with(z, {ends}, (x, e) -> struct(e - x.size AS start, e AS stop, x.kept AS kept)),"
        f" x -> x.kept >= {least})"
    )
    zipped = (
        f"zip_with(zip_with(slice({gap}, 1, size({size})), {size}, (g, s) -> struct(g AS gap, s AS size)), {kept},"
        " (x, k) -> struct(x.gap AS gap, x.size AS size, k AS kept))"
    )
    let = f"transform(array({zipped}), z -> transform({found}, x -> struct(x.start AS start, x.stop AS stop)))[0]"
    return F.expr(f"CASE WHEN {text} RLIKE '{p}' THEN {let} ELSE {NO_SPANS} END")


def masked(text: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text with ``MASK`` for every character of a match whose group is not shorter than ``least``."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    whole, kept = (f"regexp_extract_all({text}, '{p}', {g})" for g in (0, group))
    covers = f"zip_with({whole}, {kept}, (m, g) -> if(length(g) >= {least}, repeat('{MASK}', length(m)), m))"
    joined = f"array_join(zip_with(split({text}, '{p}', -1), {covers}, (a, m) -> concat(a, coalesce(m, ''))), '')"
    return F.expr(f"CASE WHEN {text} RLIKE '{p}' THEN {joined} ELSE {text} END")


def parts(runs: DataFrame) -> DataFrame:
    """The parts of runs that are tested, with their places: a name glued to a key, or the folders before it,
    are not of the key's encoding."""

    def cut(df: DataFrame, *patterns: str) -> DataFrame:
        places = F.array_distinct(F.concat(*[spans_of("s", p) for p in patterns]))
        df = df.withColumn("place", F.explode(places))
        place = "start + place.start AS start", "start + place.stop AS stop"
        return df.selectExpr("k1", "k2", *place, "substr(s, place.start + 1, place.stop - place.start) AS s")

    found = cut(runs, PART)
    return found.where(F.col("s").rlike(FITS)).union(cut(found.where(~F.col("s").rlike(FITS)), *NARROW))


def normal_cdf(z: str) -> str:
    """The normal distribution function by its logistic approximation, right to 0.0002."""
    return f"(1 / (1 + exp(least(700D, greatest(-700D, -1.5976D * ({z}) - 0.07056D * pow({z}, 3))))))"


def battery(candidates: DataFrame) -> DataFrame:
    """Adds to strings ``s`` the results of the tests: ``looks_random`` and the p-value of ordinary
    writing as its ``bucket`` (its negative logarithm in steps), and the ``band`` of its length.

    Strings of no known encoding, or of digits alone, are dropped: no alphabet can be tested.
    """
    df = candidates.withColumn("body", F.regexp_replace("s", "=+$", "")).where(F.length("body") >= 16)
    kinds = [
        F.when(F.col("body").rlike(p), F.struct(F.lit(name).alias("name"), F.lit(a).alias("alphabet"), F.lit(c).alias("agree")))
        for name, p, a, c in ENCODINGS
    ]
    df = df.withColumn("encoding", F.coalesce(*kinds)).select("*", "encoding.alphabet", "encoding.agree")
    df = df.where("encoding IS NOT NULL AND body RLIKE '[A-Za-z]'")
    df = df.withColumn("body", F.when(F.col("encoding.name") == "hex", F.lower("body")).otherwise(F.col("body")))
    df = df.withColumn("v", F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> locate(c, alphabet) - 1D)"))
    df = df.withColumns({"n": F.size("v").cast("double"), "k": F.length("alphabet").cast("double")})
    squares = "aggregate(array_distinct(v), 0D, (a, x) -> a + pow(size(filter(v, y -> y = x)), 2))"
    mean = "aggregate(v, 0D, (a, x) -> a + x) / n"
    df = df.withColumns({"squares": F.expr(squares), "mean": F.expr(mean)})
    df = df.withColumns(
        {
            "chi": F.expr("(k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)"),
            "high": F.expr("transform(v, x -> if(x >= k / 2, 1, 0))"),
            "spread": F.expr("aggregate(v, 0D, (a, x) -> a + pow(x - mean, 2))"),
            "lagged": F.expr(
                "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> (x - mean) * (y - mean)),"
                " 0D, (a, x) -> a + x)"
            ),
        }
    )
    df = df.withColumns(
        {
            "ups": F.expr("aggregate(high, 0D, (a, x) -> a + x)"),
            "runs": F.expr(
                "1D + aggregate(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high) - 1), (x, y) -> abs(x - y)),"
                " 0D, (a, x) -> a + x)"
            ),
        }
    )
    df = df.withColumn("downs", F.expr("n - ups"))
    df = df.withColumns(
        {
            "runs_z": F.expr(
                "if(ups < 2 OR downs < 2, 99D, (runs - 1 - 2 * ups * downs / n)"
                " / sqrt(2 * ups * downs * (2 * ups * downs - n) / (n * n * (n - 1))))"
            ),
            "serial_z": F.expr("if(spread = 0, 99D, (lagged / spread + 1 / n) * sqrt(n))"),
            "same": F.expr("(squares - n) / (n * (n - 1))"),
            "same_sd": F.expr("sqrt(2 * agree * (1 - agree) / (n * (n - 1)) + 0.006D / n)"),
        }
    )
    uneven = f"1 - {normal_cdf('chi')}"
    unruly = [f"2 * (1 - {normal_cdf(f'abs({z})')})" for z in ("runs_z", "serial_z")]
    random = " AND ".join(f"{p} >= {LEVEL / 3}" for p in [uneven, *unruly])
    writing = normal_cdf("(same - agree) / same_sd")
    return df.withColumns(
        {
            "looks_random": F.expr(random),
            "bucket": F.expr(f"cast(floor(-ln({writing}) * {STEPS}) AS int)"),
            "band": F.expr("CASE WHEN n < 32 THEN 0 WHEN n < 48 THEN 1 WHEN n < 64 THEN 2 ELSE 3 END"),
        }
    )


def thresholds(tested: DataFrame) -> DataFrame:
    """Per band, the first bucket whose strings are all flagged (Benjamini and Hochberg 1995).

    The p-values of a bucket count as the largest of it.
    """
    counts = tested.groupBy("band", "bucket").count()
    down = Window.partitionBy("band").orderBy(F.desc("bucket"))
    whole = Window.partitionBy("band")
    counts = counts.select(
        "band", "bucket", F.sum("count").over(down).alias("flagged"), F.sum("count").over(whole).alias("m")
    )
    fits = F.expr(f"exp(-bucket / {STEPS}D) <= {FALSE_SHARE} * flagged / m")
    return counts.where(fits).groupBy("band").agg(F.min("bucket").alias("least"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``spans``, arrays of ``start``, ``kind`` (number in
    ``KINDS``) and ``stop`` in code points, in order.

    NULL and empty texts have none. Texts of any length are scanned whole. Rows with the same
    doc_id and text get the same spans; an empty table gives an empty one; other columns are not read.
    """
    k1, k2 = row_keys(docs, ["doc_id", "text"])
    text = docs.select(k1.alias("k1"), k2.alias("k2"), docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    found = text.select(
        "k1", "k2", "doc_id", "t",
        spans_of("t", ASSIGN, "1", 8).alias("assign"), spans_of("t", ACCESS).alias("access"),
        spans_of("t", HEX).alias("hex"), masked("t", ASSIGN, 1, 8).alias("u"),
    )
    for pattern in (ACCESS, HEX):
        found = found.withColumn("u", masked("u", pattern))
    found = found.withColumn("run", spans_of("u", RUN))
    tagged = ", ".join(
        f"transform({kind}, x -> struct(x.start AS start, {i} AS kind, x.stop AS stop))" for i, kind in enumerate(KINDS[:3])
    )
    found = found.withColumn("base", F.expr(f"sort_array(concat({tagged}))"))
    strings = "transform(run, r -> struct(r.start AS start, r.stop AS stop, substr(t, r.start + 1, r.stop - r.start) AS s))"
    found = written(found.select("k1", "k2", "doc_id", "base", F.expr(strings).alias("run")), "secrets")
    tested = battery(parts(found.where(F.size("run") > 0).select("k1", "k2", F.inline("run"))))
    tested = written(tested.select("k1", "k2", "start", "stop", "band", "bucket", "looks_random"), "battery")
    flagged = tested.join(F.broadcast(thresholds(tested)), "band").where("bucket >= least AND looks_random")
    more = flagged.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("start", F.lit(3).alias("kind"), "stop")).alias("more")
    )
    inner = "exists(more, y -> y <> x AND y.start <= x.start AND x.stop <= y.stop)"
    more = more.withColumn("more", F.expr(f"filter(more, x -> NOT {inner})"))
    every = found.join(more, ["k1", "k2"], "left")
    spans = F.expr("sort_array(concat(base, coalesce(more, filter(base, x -> false))))")
    return every.select("doc_id", "base", spans.alias("spans"))


def told(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.kind], x.start, x.stop)), ',')"
    )
