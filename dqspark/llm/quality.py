"""Quality rules that vote or abstain; expectation-maximisation weighs the votes.

Each rule looks at one property of a document and votes to reject it, to keep it, or not at all.
Which rules can be trusted is learned from how their votes agree over all documents: the counts
of the vote patterns (at most three to the number of rules, whatever the number of documents) are
enough for expectation-maximisation, and the posterior of a pattern is that of its documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import SPACE, WORD_CHAR, count_of, words, written

#: Counted characters: symbols of the base rule, then capitals and sentence ends.
SYMBOLS = "#*$%&|<>"

#: Name, when it votes to reject, when to keep; in other cases the rule abstains.
RULES: tuple[tuple[str, str, str | None], ...] = (
    ("symbols", "n_symbols > 0.2 * n_words", None),
    ("capitals", "n_upper > 0.5 * word_chars", None),
    ("shouting", "n_exclaim > 0.3 * n_words", None),
    ("lines", "n_dup_lines > 0.7 * n_lines", None),
    ("windows", "n_repeat_words > 0.4 * n_words", "n_words >= 50 AND n_repeat_words < 0.1 * n_words"),
    ("variety", "n_distinct < 0.15 * n_words", None),
    ("lengths", "word_chars < 2 * n_words OR word_chars > 14 * n_words", None),
    (
        "prose",
        "n_words >= 50 AND n_stops < 0.005 * n_words",
        "n_words >= 50 AND n_stops BETWEEN 0.02 * n_words AND 0.4 * n_words"
        " AND n_symbols <= 0.05 * n_words AND n_upper < 0.2 * word_chars",
    ),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*BASE, "n_lines", "n_distinct", "n_upper", "n_exclaim", "n_stops")


def features(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per document: the carried columns as ``row``, and the counted properties.

    Positions of repeated three-word windows are found by sorting, within the document, the
    hashes of its windows with the position in the lowest bits; of windows that share a hash the words
    themselves are sorted and compared, so the counts are exact.
    """
    row = F.struct(*[docs[c] for c in carry])
    df = docs.select(row.alias("row"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CHAR))
    df = df.select("row", "t", words(F.col("t")).alias("w"), lines.alias("l"))
    df = df.select(
        "row",
        "w",
        F.size("w").alias("n"),
        F.greatest(F.lit(1), F.ceil(F.log2(F.size("w") + 1))).cast("int").alias("bits"),
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.length(F.regexp_replace("t", SPACE, "")).alias("word_chars"),
        F.regexp_replace("t", rf"[^A-Z!.?{SYMBOLS}]+", "").alias("marks"),
    )
    packed = F.expr("transform(sequence(0, n - 3), i -> shiftleft(shiftright("
                    "xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), bits), bits) | i)")  # fmt: skip
    none = F.array().cast("array<bigint>")
    df = df.withColumn("v", F.when(F.col("n") >= 3, packed).otherwise(none))
    df = df.withColumn("v", F.sort_array("v"))
    # the windows whose predecessor in hash order has the same hash, and those predecessors
    twice = F.when(
        F.size("v") >= 2,
        F.expr("filter(sequence(1, size(v) - 1), i -> shiftright(v[i], bits) = shiftright(v[i - 1], bits))"),
    ).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("twice", twice)
    at = "transform(twice, i -> v[i{}] & (shiftleft(1L, bits) - 1))"
    df = df.withColumn("at", F.expr(f"array_distinct(concat({at.format('')}, {at.format(' - 1')}))"))
    # of those the ones whose words are the same: hashes only pick them
    window = "concat_ws(' ', get(w, cast(i AS int)), get(w, cast(i AS int) + 1), get(w, cast(i AS int) + 2))"
    df = df.withColumn("same", F.expr(f"sort_array(transform(at, i -> named_struct('k', {window}, 'i', i)))")).drop("w", "at")
    twin = "same[j].k <=> get(same, j - 1).k OR same[j].k <=> get(same, j + 1).k"
    exact = F.expr(f"transform(filter(sequence(0, size(same) - 1), j -> {twin}), j -> same[j].i)")
    df = df.withColumn("at", F.when(F.size("same") >= 2, exact).otherwise(none))
    covered = F.expr("size(array_distinct(concat(at, transform(at, x -> x + 1), transform(at, x -> x + 2))))")
    return df.select(
        "row",
        F.col("n").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        count_of(F.col("marks"), SYMBOLS).cast("bigint").alias("n_symbols"),
        F.col("n_dup_lines").cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        "n_lines",
        "n_distinct",
        count_of(F.col("marks"), "A-Z").alias("n_upper"),
        count_of(F.col("marks"), "!").alias("n_exclaim"),
        count_of(F.col("marks"), ".?!").alias("n_stops"),
    )


def vote_pattern() -> Column:
    """One character per rule: ``r`` to reject, ``k`` to keep, ``-`` to abstain."""
    votes = []
    for _, reject, keep in RULES:
        vote = F.when(F.expr(reject), "r")
        votes.append((vote.when(F.expr(keep), "k") if keep else vote).otherwise("-"))
    return F.concat(*votes)


@dataclass
class VoteModel:
    """What expectation-maximisation found: the share of bad documents, and per rule the
    probability of each vote in bad and in good documents."""

    bad_share: float
    bad: list[dict[str, float]]
    good: list[dict[str, float]]

    def log_odds(self, pattern: str) -> float:
        """The logarithm of the odds that a document with these votes is bad; who abstains says nothing."""
        total = math.log(self.bad_share / (1 - self.bad_share))
        cast = [x for x in zip(self.bad, self.good, pattern, strict=True) if x[2] != "-"]
        return total + sum(math.log(b[v] / g[v]) for b, g, v in cast)

    def accuracy(self) -> dict[str, float]:
        """Per rule: how often its votes are right, where it votes."""
        out = {}
        for (name, _, _), b, g in zip(RULES, self.bad, self.good, strict=True):
            right = self.bad_share * b["r"] + (1 - self.bad_share) * g["k"]
            wrong = self.bad_share * b["k"] + (1 - self.bad_share) * g["r"]
            out[name] = right / (right + wrong)
        return out


#: Votes counted before any is seen, and the largest share of good documents that a rule may vote to reject.
PRIOR = {"bad": {"r": 4.5, "k": 0.5, "-": 5.0}, "good": {"r": 0.5, "k": 1.5, "-": 8.0}}
FALSE_REJECTS = 0.01


def fit(counts: dict[str, int], rounds: int = 100) -> VoteModel:
    """Expectation-maximisation over vote patterns and how many documents have each.

    Starts from the belief that a vote to reject is right, and holds on to this much of it: a rule
    rejects at most ``FALSE_REJECTS`` of the good documents. Else, where rules find different kinds of
    junk, the commonest kind could be learned as the good one. Without documents the prior stands.
    """
    patterns = sorted(counts)
    belief = {p: 0.9 if "r" in p else 0.05 for p in patterns}
    model = None
    for _ in range(rounds):
        votes = {"bad": [], "good": []}
        for side in votes:
            for i in range(len(RULES)):
                total = dict(PRIOR[side])
                for p in patterns:
                    total[p[i]] += counts[p] * (belief[p] if side == "bad" else 1 - belief[p])
                whole = sum(total.values())
                votes[side].append({v: n / whole for v, n in total.items()})
                if side == "good":
                    votes[side][-1]["r"] = min(votes[side][-1]["r"], FALSE_REJECTS)
        share = (1 + sum(counts[p] * belief[p] for p in patterns)) / (10 + sum(counts.values()))
        model = VoteModel(share, votes["bad"], votes["good"])
        now = {p: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(p))))) for p in patterns}
        if all(abs(now[p] - belief[p]) < 1e-9 for p in patterns):
            break
        belief = now
    return model


def quality_rules(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Judge every document: ``row`` (the carried columns), counts, ``base_failed``, ``p_good``
    and ``kept``.

    NULL and empty texts have no words and so fail the base rule. Texts may be of any length;
    equal rows get equal results; other columns of the input play no part, whatever their names.
    An empty table gives an empty one.
    """
    base_failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    table = features(docs, carry).withColumn("votes", vote_pattern())
    table = written(table.withColumn("base_failed", base_failed), "quality")
    # at most three to the number of rules rows
    counts = {r["votes"]: r["count"] for r in table.groupBy("votes").count().collect()}
    model = fit(counts)
    spark = docs.sparkSession
    scores = [(p, 1 / (1 + math.exp(max(-700.0, min(700.0, model.log_odds(p)))))) for p in sorted(counts)]
    scored = F.broadcast(spark.createDataFrame(scores, "votes string, p_good double"))
    return table.join(scored, "votes").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    judged = quality_rules(docs, docs.columns)
    return judged.where("kept").select("row.*")
