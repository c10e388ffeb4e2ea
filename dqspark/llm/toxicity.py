"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value statistics.

Every token has the log-odds of its use in toxic against other documents, with an informative Dirichlet prior. A
token is known by its word and by the word's beginnings; the unit whose log-odds stand furthest from zero
for their variance speaks for it, so words never seen score by their stem. One pass over the scores of a text finds all its
maximal segments (the runs that no shorter or longer run within or around them beats). How surprising
such segments are in clean text is known from extreme-value theory: a segment of score s in n tokens is expected
K * n * exp(-lambda * s) times. Sum statistics put the segments of a document together, and how the result is
spread among clean and among toxic labelled documents, a Gumbel distribution each, calibrates it to a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import ship, written
from dqspark.llm.mixing import mixed64

#: Labelled documents that the fit reads at most (those with the smallest hashes of their ids), as its one bound.
LABELLED = 1 << 14
#: Two rows of so many counters hold the counts of units; a unit's count is the smaller of its two.
WIDTH = 1 << 19
SPARE = 2 * WIDTH
#: Letters of the beginnings of a word that are units beside the word.
STEMS = (3, 4, 5, 6, 7)
#: Occurrences that the prior adds: each unit the same, and all together in proportion to their use.
FLAT, INFORMED = 0.5, 1000.0
#: Log-odds count from so many standard deviations on; every token costs so much, so that clean text sinks.
LEAST_Z, DRIFT = 2.5, 0.05
#: From this probability on a document is predicted to be toxic; segments of a document put together.
THRESHOLD, TOGETHER = 0.3, 32
#: Tokens scored at a time, and words that a worker remembers.
ROUND, WORDS, PART = 1 << 16, 400_000, 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def units(words: list[str]) -> np.ndarray:
    """The counters of words and of their beginnings, two for each: an array of words by units by two. Where a word has no
    such beginning, or is no longer, stands the spare counter behind the last."""
    import xxhash

    whole = np.array([xxhash.xxh64_intdigest(w.encode(), 13) for w in words], np.uint64)
    length = np.array([len(w) for w in words])
    letters = np.array([w[: STEMS[-1]] for w in words], f"U{STEMS[-1]}").view(np.uint32).reshape(len(words), STEMS[-1])
    columns, h = [whole], np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(STEMS[-1]):
            h = mixed64(h * np.uint64(31) + letters[:, k] + np.uint64(k + 1))
            if k + 1 in STEMS:
                columns.append(h)
    h = np.stack(columns, axis=1)
    at = np.stack([h % np.uint64(WIDTH), np.uint64(WIDTH) + (h >> np.uint64(32)) % np.uint64(WIDTH)], axis=2).astype(np.int32)
    at[:, 1:][length[:, None] <= np.array(STEMS)] = SPARE
    return at


class Units:
    """The counters of words, remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 1 + len(STEMS), 2), np.int32)

    def of(self, words: set[str]) -> np.ndarray:
        if len(self.known) > WORDS:
            self.known.clear()
        new = sorted(w for w in words if w not in self.known)  # a difference of sets would walk through all known
        n = len(self.known)
        while n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            self.table[n : n + len(new)] = units(new)
            self.known.update(zip(new, range(n, n + len(new))))
        return self.table[[self.known[w] for w in sorted(words)]]


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case; those of a long one some at a time."""
    if len(text) <= PART:
        yield WORD.findall(text.lower())
        return
    held = []
    for m in WORD.finditer(text):
        held.append(m.group().lower())
        if len(held) == ROUND:
            yield held
            held = []
    yield held


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """The log-odds of units given their counts on both sides (zero where the variance explains them), and how many
    standard deviations they are from zero."""
    prior = FLAT + INFORMED * (toxic + clean) / max(1.0, n_toxic + n_clean)
    all_prior = FLAT * WIDTH + INFORMED
    a, b = toxic + prior, clean + prior
    value = np.log(a / (n_toxic + all_prior - a)) - np.log(b / (n_clean + all_prior - b))
    spread = np.sqrt(1 / a + 1 / b)
    return np.where(np.abs(value) >= LEAST_Z * spread, value, 0.0), np.abs(value) / spread


@dataclass
class Segment:
    """A run of tokens, ``end`` exclusive, and what it scores."""

    start: int
    end: int
    score: float


def maximal_segments(scores: list[float] | np.ndarray) -> list[Segment]:
    """All maximal-scoring segments of positive score, from left to right, in linear time.

    Each run keeps the sum of all scores before it and up to its end. A positive score begins a run; it is joined with the
    last earlier run that begins lower, as long as that one ends lower too, for then the whole beats both. Only
    tokens of positive score are visited; what lies between is in the sums.
    """
    scores = np.asarray(scores, float)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    runs: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, earlier run that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= low:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= high:
                runs.append((start, end, low, high, j))
                break
            start, low = runs[j][0], runs[j][2]
            del runs[j:]
    return [Segment(s, e, high - low) for s, e, low, high, _ in runs]


@dataclass
class Model:
    """Counts of units on both sides, the segment statistics of clean text, and the calibration."""

    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: float
    n_clean: float
    decay: float = 1.0  # lambda
    factor: float = 1.0  # K
    curve: tuple[np.ndarray, np.ndarray] | None = None  # surprise and probability, both ascending

    def token_scores(self, at: np.ndarray, left_out: bool | None = None) -> np.ndarray:
        """What each word adds, given its counters. With ``left_out`` a document with all these words is taken out of the
        counts of its side (toxic or not) first."""
        toxic, clean = (x[at].min(axis=2).astype(float) - (left_out is side) for x, side in ((self.toxic, True), (self.clean, False)))
        spare = at[:, :, 0] == SPARE
        toxic[spare] = clean[spare] = 0
        value, z = log_odds(toxic, clean, self.n_toxic, self.n_clean)
        z[spare] = -1
        return np.take_along_axis(value, z.argmax(axis=1)[:, None], 1)[:, 0] - DRIFT

    def surprise(self, segments: list[float], n: int) -> float:
        """Minus the logarithm of how likely clean text of ``n`` tokens has segments as good as the best of these.

        For the r best of them the normalised scores are summed to t; their chance is about exp(-t) t^(r-1) /
        (r! (r-1)!). The smallest over r counts, each r paying a factor 2^r for the choice.
        """
        if not segments:
            return 0.0
        best = sorted(segments, reverse=True)[:TOGETHER]
        shift = math.log(self.factor * max(2, n))
        t, found = 0.0, 0.0
        for r, s in enumerate(best, 1):
            t += self.decay * s - shift
            if t <= 0:
                break
            chance = -t + (r - 1) * math.log(t) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
            found = max(found, -chance)
        return found

    def probability(self, surprise: float) -> float:
        if self.curve is None:
            return 0.0
        return float(np.interp(surprise, *self.curve))


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document must not be learned from; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of the documents to learn from.

    A document with several labels is toxic if one says so. At most ``LABELLED`` ids are taken, so they can be sent to
    every task, and texts are not shuffled.
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(known["doc_id"].alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where(docs["text"].isNotNull())
    return rows.join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")


def different(text: str) -> set[str]:
    """The different words of a text."""
    return {w for part in words_of(text) for w in part}


def counted(texts: DataFrame) -> DataFrame:
    """``counter``, ``toxic``, ``clean``: how many documents of each side hold a unit, added up within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, memory = np.zeros((2, SPARE + 1), np.int64), Units()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[int(toxic)][np.unique(memory.of(different(text)))] += 1
        at = np.flatnonzero(sums[:, :SPARE].any(axis=0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            columns = [pa.array(part, pa.int64()), pa.array(sums[1][part]), pa.array(sums[0][part])]
            yield pa.RecordBatch.from_arrays(columns, ["counter", "toxic", "clean"])

    rows = texts.select("text", "toxic").mapInArrow(count, "counter bigint, toxic bigint, clean bigint")
    return rows.groupBy("counter").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def segment_decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p(s) exp(lambda * s) = 1 for the scores of clean tokens; 1 where there is none."""
    if not (scores > 0).any() or (scores * counts).sum() >= 0:
        return 1.0
    p, low, high = counts / counts.sum(), 0.0, 1.0
    with np.errstate(over="ignore"):
        while (p * np.exp(high * scores)).sum() < 1 and high < 64:
            low, high = high, high * 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return max(0.05, low)


def gumbel(values: np.ndarray) -> tuple[float, float]:
    """Place and scale of the Gumbel distribution with the mean and variance of some values."""
    scale = max(0.5, float(values.std()) * math.sqrt(6) / math.pi)
    return float(values.mean()) - 0.5772156649015329 * scale, scale


def calibration(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability that a document is toxic by its surprise: two Gumbel densities weighed by their shares,
    made ascending."""
    (m1, s1), (m0, s0) = gumbel(toxic), gumbel(clean)
    x = np.linspace(0, max(60.0, float(np.concatenate([toxic, clean]).max())), 1200)
    density = [-(x - m) / s - np.exp(np.minimum(700, -(x - m) / s)) - math.log(s) for m, s in ((m1, s1), (m0, s0))]
    odds = math.log((len(toxic) + 0.5) / (len(clean) + 0.5)) + density[0] - density[1]
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    # left of the clean documents' place both densities vanish: no more toxic there than at that place
    p[x < m0] = np.minimum(p[x < m0], p[np.searchsorted(x, max(m0, 0.0)) - (m0 > x[-1])])
    return x, np.maximum.accumulate(p)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn a model from labelled documents.

    The counts are those of units in all of them. Statistics and calibration come from each document scored without its own
    counts, as a document would be that was never learned. Without labels of both sides nothing is toxic.
    """
    texts = written(labelled_texts(docs, labels), "labelled")
    sides = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    found = counted(texts).toArrow()  # two rows of counters at most
    model = Model(np.zeros(SPARE + 1, np.float32), np.zeros(SPARE + 1, np.float32), 0.0, 0.0)
    at, toxic, clean = (c.to_numpy() for c in found.columns)
    model.toxic[at], model.clean[at] = toxic, clean
    model.n_toxic, model.n_clean = toxic.sum() / 2, clean.sum() / 2
    if len(sides) < 2:
        return model
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Units()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = different(text)
                own = dict(zip(sorted(words), model.token_scores(memory.of(words), toxic).tolist())) if words else {}
                parts = [np.array([own[w] for w in part]) for part in words_of(text)]
                n = sum(map(len, parts))
                scores = np.concatenate(parts) if parts else np.zeros(0)
                values, many = np.unique(np.round(scores, 1), return_counts=True)
                best = sorted((s.score for s in maximal_segments(scores)), reverse=True)[:TOGETHER]
                rows.append((toxic, n, values.tolist(), many.tolist(), best))
            kinds = (pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "n", "s", "many", "best"])

    schema = "toxic boolean, n bigint, s array<double>, many array<bigint>, best array<double>"
    scored = written(texts.select("text", "toxic").mapInArrow(score, schema), "scored")
    tokens = scored.where("NOT toxic").select(F.explode(F.arrays_zip("s", "many")).alias("x"))
    tokens = tokens.groupBy("x.s").agg(F.sum("x.many").alias("many")).toPandas()  # a row per tenth of a score
    if len(tokens):
        model.decay = segment_decay(tokens["s"].to_numpy(), tokens["many"].to_numpy(float))
    seen = scored.select("toxic", "n", "best").collect()  # LABELLED rows at most, unless ids repeat
    # K from the expected count of segments in clean text above the score that one in ten documents reaches
    clean = [r for r in seen if not r["toxic"] and r["n"]]
    heights = np.array([max(r["best"], default=0.0) for r in clean])
    level = max(np.quantile(heights, 0.9), 0.1) if len(clean) else 0.1
    expected = sum(sum(s >= level for s in r["best"]) for r in clean)
    model.factor = max(1e-4, expected / max(1, sum(r["n"] for r in clean)) * math.exp(min(50.0, model.decay * level)))
    by_side = [np.array([model.surprise(r["best"], r["n"]) for r in seen if r["toxic"] == side]) for side in (True, False)]
    model.curve = calibration(*by_side)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``n_words``, ``surprise`` and ``passages`` (first word, end, score and expected count in clean text
    of every segment expected less than once in a hundred such documents) of every document.

    NULL and empty texts have no words and no passage; they score as the least surprising documents do. Texts are read whole,
    in parts of ``ROUND`` words; a worker holds one document's scores. Nothing is shuffled. Repeated rows and
    NULL ids are documents each; an empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                parts = []
                for part in words_of(text or ""):
                    got = list(map(known.get, part))
                    if None in got:
                        new = sorted({w for w, s in zip(part, got) if s is None})
                        known.update(zip(new, model.token_scores(units(new)).tolist()))
                        got = [known[w] for w in part]
                    parts.append(np.array(got, float))
                    if len(known) > WORDS:
                        known.clear()
                scores = np.concatenate(parts) if parts else np.zeros(0)
                n, found = len(scores), maximal_segments(scores)
                surprise = model.surprise([s.score for s in found], n)
                chances = [model.factor * max(2, n) * math.exp(max(-700.0, -model.decay * s.score)) for s in found]
                passages = [{"start": s.start, "end": s.end, "score": s.score, "expected": e} for s, e in zip(found, chances) if e < 0.01]
                rows.append((model.probability(surprise), n, surprise, passages))
            kinds = (pa.float64(), pa.int64(), pa.float64(), passage_type)
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "score", "n_words", "surprise", "passages"])

    passage_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
    passage = "array<struct<start: bigint, end: bigint, score: double, expected: double>>"
    schema = f"doc_id {kind}, score double, n_words bigint, surprise double, passages {passage}"
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(score, schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out and score every document: ``doc_id``, ``held_out``, ``score``, ``predicted``
    (1 from ``THRESHOLD`` on), ``n_words`` and ``n_passages``."""
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_words",
        F.size("passages").cast("bigint").alias("n_passages"),
    )
