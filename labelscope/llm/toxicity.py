"""Toxic passages by maximum-scoring segments.

``fit`` counts words of labelled texts per class in Spark. A word's log-odds are
those of its counts under a Dirichlet prior, whose mean follows the word's stem
(its first letters), so that rare forms lean on the stem and unseen ones take
the stem's own log-odds; all other words cost a small drift. ``score`` scans each
whole text once for all maximal scoring segments (linear time). Under a null text
the best segment follows an extreme-value law: lambda solves its defining
equation over the null word frequencies, K is fitted by maximum likelihood on
clean training texts. A document's evidence is the sum of its segments' -ln E,
for E-values under 1, and a logistic curve fitted on training texts turns it into
a probability. Weights and curve see different halves of the training texts.

The fit reads a bounded sample: about ``TRAIN_ROWS_PER_CLASS`` texts of a class.

Defined results: NULL, empty and blank texts have no evidence and get the score
of a text without any; without labelled texts of both classes every score is 0.
Rows that repeat a label count once, as toxic if any of them is.
"""

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import WordTable, blocks, even_share, fold_of, kept, table, utf8

TRAIN_ROWS_PER_CLASS = 10_000
#: The words and stems that are broadcast, at most.
MAX_WORDS = 100_000
STEM = 5
LEAST_TEXTS = 3
PRIOR_WEIGHT = 2.0
#: What a word without log-odds costs a segment.
DRIFT = 0.05
LEAST_LOG_ODDS = 1.5
RESULT = "score double, passages array<struct<first:long,last:long,score:double,e_value:double>>"
_COUNTS = "key string, half int, toxic int, n long"


def canonical(word: bytes) -> bytes:
    """A word without case and the signs around it."""
    w = word.decode("utf-8", "replace").lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while a < b and not w[b - 1].isalnum():
        b -= 1
    return w[a:b].encode()


def stem(word: bytes) -> bytes | None:
    """The key of a word's stem, or None for a short word."""
    w = word.decode("utf-8", "replace")
    return b"*" + w[:STEM].encode() if len(w) > STEM else None


@dataclass(frozen=True)
class Weights:
    log_odds: dict[bytes, float]
    lam: float

    def of(self, word: bytes) -> float:
        w = canonical(word)
        found = self.log_odds.get(w)
        if found is None and (s := stem(w)):
            found = self.log_odds.get(s)
        return -DRIFT if found is None else found - DRIFT


@dataclass(frozen=True)
class Model:
    weights: Weights
    k: float
    slope: float
    base: float

    def e_value(self, score: float, n_words: int) -> float:
        return self.k * max(n_words, 1) * math.exp(-self.weights.lam * score)

    def evidence(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        return sum(max(0.0, -math.log(max(self.e_value(s, n_words), 1e-300))) for *_, s in segments)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.base + self.slope * math.log1p(evidence)))))


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a text.

    ``places`` and ``scores`` are its words of positive score; every other word
    costs ``drift``. Each open segment remembers the running sums at its two
    ends and the nearest one before it that starts lower, so the scan is linear.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    lower: list[int] = []
    total, at = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (place - at)
        first, before = place, total
        total += score
        at = place + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                found.append((first, place, before, total))
                lower.append(j)
                break
            first, before = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, b, end - start) for a, b, start, end in found]


def segments_of(texts: list[bytes], cache: WordTable) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Number of words and maximal segments of each text."""
    for held, starts in blocks(texts, bytes.split):
        values = cache.values([w for words in held for w in words])
        hits = np.flatnonzero(values > 0)
        bounds = np.searchsorted(hits, starts)
        for i, words in enumerate(held):
            own = hits[bounds[i]:bounds[i + 1]]
            yield len(words), maximal_segments(own - starts[i], values[own]) if len(own) else []


def word_scores(weights: Weights) -> WordTable:
    return WordTable(lambda words: np.array([weights.of(w) for w in words], float), 200_000)


# --- fitting ---------------------------------------------------------------------


def training_sample(labels: DataFrame, usable: Column, rows_per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """``doc_id, toxic, half`` of the sample, and what a row of each class weighs."""
    known = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {y: min(1.0, rows_per_class / sizes[y]) for y in sizes}
    share = F.when(F.col("toxic") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))
    sample = known.where(even_share(F.col("doc_id")) < share)
    half = (F.hash("doc_id", F.lit(17)).bitwiseAND(F.lit(1))).alias("half")
    return sample.select("doc_id", "toxic", half), {y: 1 / shares[y] for y in shares}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class and half a word, a stem, and any word stand."""
    totals: dict[tuple[int, int], Counter] = {}
    names: dict[bytes, tuple[bytes, bytes | None]] = {}
    for batch in batches:
        for text, toxic, half in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["half"].to_pylist(), strict=True):
            seen: set[bytes] = set()
            for word in set(text.split()):
                if (found := names.get(word)) is None:
                    if len(names) > 300_000:
                        names.clear()
                    found = names[word] = ((w := canonical(word)), stem(w))
                seen.update(found)
            seen.discard(None)
            own = totals.setdefault((half, toxic), Counter())
            own[b"*"] += sum(not k.startswith(b"*") for k in seen)
            own.update(k for k in seen if k not in (b"", b"*"))
    for (half, toxic), own in totals.items():
        keys = list(own)
        for at in range(0, len(keys), 50_000):
            some = keys[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([k.decode("utf-8", "replace") for k in some]), pa.array([half] * len(some), pa.int32()),
                pa.array([toxic] * len(some), pa.int32()), pa.array([own[k] for k in some], pa.int64())], ["key", "half", "toxic", "n"])


def weigh(keys: list[bytes], toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> Weights:
    """Log-odds of words and stems from their counts."""
    rate = all_toxic / (all_toxic + all_clean)
    share = dict(zip(keys, (toxic + PRIOR_WEIGHT * rate) / (toxic + clean + PRIOR_WEIGHT), strict=True))
    base = math.log(all_toxic / all_clean)
    kept, null, kept_null = {}, 0.0, []
    for key, a, b in zip(keys, toxic, clean, strict=True):
        if a < LEAST_TEXTS:
            continue
        mean = rate if key.startswith(b"*") or not (s := stem(key)) else share.get(s, rate)
        odds = math.log((a + PRIOR_WEIGHT * mean) / (b + PRIOR_WEIGHT * (1 - mean))) - base
        if odds >= LEAST_LOG_ODDS:
            kept[key] = odds
            if not key.startswith(b"*"):
                p = (b + PRIOR_WEIGHT * (1 - mean)) / (all_clean + PRIOR_WEIGHT)
                kept_null.append((odds - DRIFT, p))
                null += p
    # Lambda: the null expectation of exp(lambda * score) is 1.
    expected = lambda lam: sum(p * math.exp(min(700.0, lam * s)) for s, p in kept_null) + max(0.0, 1 - null) * math.exp(-lam * DRIFT) - 1
    low, high = 1e-3, 1.0
    while kept_null and expected(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < 0 else (low, middle)
    return Weights(kept, high if kept_null else 1.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows_per_class: int = TRAIN_ROWS_PER_CLASS) -> Model | None:
    """Learn from ``docs`` (doc_id, text) whose ``labels`` row (doc_id, toxic) is ``usable``."""
    spark = docs.sparkSession
    chosen, weight = training_sample(labels, usable, rows_per_class)
    if len(weight) < 2:
        return None
    # Bounded by the sample's size: a few hundred kB.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(utf8(F.col("text")).alias("text"), "toxic", "half")
    counts = texts.mapInArrow(_count, _COUNTS).groupBy("key").agg(*[
        F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)])
    toxic, clean = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    rows = counts.where((F.col("key") == "*") | (toxic >= LEAST_TEXTS) & (toxic > clean / 50)).orderBy(
        F.when(F.col("key") == "*", 0).otherwise(1), F.desc(toxic / (clean + 1)), "key").limit(MAX_WORDS).toPandas()
    everything = rows["key"] == "*"
    if not everything.any():
        return None
    of_all, rows = rows[everything].iloc[0], rows[~everything]
    keys = [k.encode() for k in rows["key"]]

    def weights(*halves: int) -> Weights:
        total = lambda frame, y: sum(frame[f"n{h}{y}"] for h in halves)
        return weigh(keys, np.asarray(total(rows, 1), float), np.asarray(total(rows, 0), float), max(1.0, total(of_all, 1)), max(1.0, total(of_all, 0)))

    shared = spark.sparkContext.broadcast((weights(1), weights(0)))  # each half under the other's weights

    def other_half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [word_scores(w) for w in shared.value]
        for batch in batches:
            halves = np.asarray(batch["half"])
            for h in (0, 1):
                some = batch.filter(pa.array(halves == h))
                found = list(segments_of(some["text"].to_pylist(), caches[h]))
                yield pa.RecordBatch.from_arrays(
                    [some["toxic"], pa.array([n for n, _ in found], pa.int64()), pa.array([[s for *_, s in x] for _, x in found], pa.list_(pa.float64()))],
                    ["toxic", "n_words", "scores"])

    seen = texts.mapInArrow(other_half, "toxic int, n_words long, scores array<double>").toPandas()
    final = weights(0, 1)
    best = np.array([max(s, default=0.0) for s in seen["scores"]])
    n = np.maximum(seen["n_words"].to_numpy(float), 1)
    null = seen["toxic"].to_numpy() == 0
    if not null.any() or null.all():
        return None
    model = Model(final, float(null.sum() / (n * np.exp(-final.lam * best))[null].sum()), 0.0, 0.0)
    evidence = np.log1p([model.evidence([(0, 0, s) for s in x], m) for x, m in zip(seen["scores"], n, strict=True)])
    base, slope = logistic(evidence, (~null).astype(float), np.where(null, weight[0], weight[1]))
    return Model(final, model.k, slope, base)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by Newton's method."""
    design, b = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        gradient = design.T @ (w * (y - p)) - ridge * b
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


# --- scoring ---------------------------------------------------------------------


def score_column(spark, model: Model | None, text: Column) -> Column:
    """``struct<score, passages>`` of a text column; passages have E-values under 1."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: Model | None = shared.value
        cache = kept(("toxic", name), lambda: word_scores(known.weights)) if known else None
        for texts in parts:
            if not known:
                yield pd.DataFrame({"score": [0.0] * len(texts), "passages": [[] for _ in texts]})
                continue
            scores, passages = [], []
            for n, found in segments_of(texts.tolist(), cache):
                scores.append(known.probability(known.evidence(found, n)))
                passages.append([{"first": a, "last": b, "score": s, "e_value": e} for a, b, s in found if (e := known.e_value(s, n)) < 1])
            yield pd.DataFrame({"score": scores, "passages": passages})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT).asNondeterministic()(utf8(text))


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, passages`` of each whole text."""
    return docs.select("doc_id", score_column(docs.sparkSession, model, F.col("text")).alias("_toxic")).select("doc_id", "_toxic.*")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
