"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams of labelled texts per language in Spark, ``predict``
broadcasts log-probabilities and scores whole texts in numpy. A word's n-grams
are hashed once per task: a document's score is the sum of its words' rows.

Every language is learned. They are broadcast in blocks of ``LANGUAGES_AT_ONCE``;
where there are several, a task reads one block at a time and carries each text's
best language and the sum of all likelihoods from block to block.

Defined results: a text that is NULL, empty or without any letter is ``und``
with score 0, as is every text when no row was labelled. Repeated rows and tied
languages change nothing: ties go to the language that sorts first.
"""

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import WordTable, blocks, cut, even_share, fold_of, kept, segment_sums, table, utf8

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Training texts of a language: all, or this many on average when it has more.
TRAIN_ROWS_PER_LANGUAGE = 4000
#: Languages of a block: the matrix in memory has BUCKETS x this many cells at most.
LANGUAGES_AT_ONCE = 32
#: Languages whose whole counts a task holds; those of others leave it batch by batch.
COUNTED_AT_ONCE = 64
#: Words times languages that are summed at once.
CELLS = 1 << 20
UNKNOWN = "und"
RESULT = "lang_pred string, score double"


@dataclass(frozen=True)
class Block:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_unseen: np.ndarray  # of a bucket without a count
    buckets: np.ndarray  # counted cells: bucket, place of the language, log-probability
    places: np.ndarray
    log_seen: np.ndarray

    def log_prob(self) -> np.ndarray:
        """Languages x buckets."""
        full = np.repeat(self.log_unseen[:, None], BUCKETS, axis=1)
        full[self.places, self.buckets] = self.log_seen
        return full


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    blocks: tuple[Broadcast, ...]  # of a Block each, in order of the languages


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of lower-cased words, each between two blanks, and the word of each."""
    padded = [f" {w.decode('utf-8', 'replace').lower()} " for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, padded), np.int64, len(words)))
    buckets, owners = [], []
    for n in ORDERS:
        count = max(0, len(codes) - n + 1)
        h = np.full(count, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k:k + count]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        whole = owner[:count] == owner[n - 1:n - 1 + count]
        buckets.append((h % np.uint32(BUCKETS))[whole])
        owners.append(owner[:count][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def fit(docs: DataFrame, usable: Column, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``usable`` holds."""
    spark = docs.sparkSession
    labelled = docs.where(usable & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), ())
    # Only languages with more rows have a share, so the broadcast side is small however many there are.
    shares = spark.createDataFrame([(k, rows_per_language / n) for k, n in sizes.items() if n > rows_per_language], "lang string, share double")
    sample = labelled.join(F.broadcast(shares), "lang", "left").where(F.col("share").isNull() | (even_share(F.col("doc_id")) < F.col("share")))
    counted = (sample.select("lang", utf8(F.col("text")).alias("text")).mapInArrow(_count, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    groups = [languages[i:i + LANGUAGES_AT_ONCE] for i in range(0, len(languages), LANGUAGES_AT_ONCE)]
    if len(groups) > 1:
        counted = cut(counted)
    rows = sum(sizes.values())
    return Model(languages, tuple(
        spark.sparkContext.broadcast(_block(counted.where(F.col("lang").isin(*group)) if len(groups) > 1 else counted, group, sizes, rows))
        for group in groups))


def _block(counted: DataFrame, languages: tuple[str, ...], sizes: dict[str, int], rows: int) -> Block:
    cells = counted.toPandas()
    places = cells["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(int)
    n = cells["n"].to_numpy(float)
    totals = np.bincount(places, n, len(languages)) + 0.5 * BUCKETS
    return Block(
        languages, np.log(np.array([sizes[k] for k in languages], float) / rows), np.log(0.5 / totals).astype(np.float32),
        cells["bucket"].to_numpy(np.int32), places.astype(np.int32), np.log((n + 0.5) / totals[places]).astype(np.float32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(text.split())
        for lang, found in words.items():
            buckets, owners = ngrams(list(found))
            times = np.fromiter(found.values(), np.int64, len(found))[owners]
            total = np.bincount(buckets, times, BUCKETS).astype(np.int64)
            if lang in totals or len(totals) < COUNTED_AT_ONCE:
                totals[lang] = totals.get(lang, 0) + total
            else:
                yield _counts(lang, total)
    for lang, total in totals.items():
        yield _counts(lang, total)


def _counts(lang: str, total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


def word_rows(hashed: tuple[np.ndarray, np.ndarray], count: int, log_prob: np.ndarray) -> np.ndarray:
    """The sum of each word's n-grams in each language: words x languages."""
    buckets, owners = hashed
    return np.stack([np.bincount(owners, own[buckets], count) for own in log_prob], axis=1)


def slices(words: list[bytes], starts: np.ndarray, size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Runs of words for ``CELLS`` sums in ``size`` languages, with the part of each document in them."""
    step = max(1, CELLS // size)
    for low in range(0, len(words), step):
        yield (part := words[low:low + step]), np.clip(starts - low, 0, len(part))


def hashed_slices(words: list[bytes], starts: np.ndarray, size: int) -> list[tuple]:
    """``(n-grams of distinct words, how many words, place of each word, parts)`` of each slice."""
    out = []
    for part, cuts in slices(words, starts, size):
        index = {w: i for i, w in enumerate(dict.fromkeys(part))}
        buckets, owners = ngrams(list(index))
        out.append(((buckets.astype(np.uint16), owners.astype(np.int32)), len(index), np.fromiter(map(index.__getitem__, part), np.int32, len(part)), cuts))
    return out


def scorer(spark, model: Model):
    """A column function ``text -> struct(lang_pred, score)``."""
    shared, name = model.blocks, uuid.uuid4().hex

    def single() -> tuple[Block, WordTable]:
        block = shared[0].value
        full = block.log_prob()
        return block, WordTable(lambda words: word_rows(ngrams(words), len(words), full), 150_000)

    def log_likelihoods(words: list[bytes], starts: np.ndarray) -> Iterator[tuple[Block, np.ndarray]]:
        """Documents x languages of each block; of several blocks one is in memory at a time."""
        if len(shared) == 1:
            block, cache = kept(("language", name), single)
            yield block, sum((segment_sums(cache.values(part), cuts) for part, cuts in slices(words, starts, len(block.languages))), block.log_prior)
            return
        hashed = hashed_slices(words, starts, LANGUAGES_AT_ONCE)
        for one in shared:
            block: Block = one.load_from_path(one._path)  # unlike its value, not kept
            full = block.log_prob()
            yield block, sum((segment_sums(word_rows(grams, count, full)[at], cuts) for grams, count, at, cuts in hashed), block.log_prior)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = [], []
            for held, starts in blocks(texts.tolist(), bytes.split):
                known = np.array([bool(shared) and has_letter(words) for words in held], bool)
                found, best, total = np.full(len(held), UNKNOWN, object), np.full(len(held), -np.inf), np.zeros(len(held))
                if known.any():
                    for block, logs in log_likelihoods([w for words in held for w in words], starts):
                        top = logs.max(axis=1)
                        better = top > best  # of tied languages the first stays
                        found[better] = np.array(block.languages, object)[logs.argmax(axis=1)[better]]
                        ahead = np.maximum(best, top)
                        total = total * np.exp(best - ahead) + np.exp(logs - ahead[:, None]).sum(axis=1)
                        best = ahead
                names += np.where(known, found, UNKNOWN).tolist()
                scores += np.divide(1, total, out=np.zeros(len(held)), where=known).tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not to be run again for a filter on its result.
    udf = F.pandas_udf(score, RESULT).asNondeterministic()
    return lambda text: udf(utf8(text))


def has_letter(words: list[bytes]) -> bool:
    return any(w.isalpha() or any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in words)


def lettered(text: Column) -> Column:
    """Whether the whole text has a letter."""

    @F.pandas_udf("boolean")
    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(t.split()) for t in texts.tolist()], dtype=bool)

    return look(utf8(text))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, language: struct(lang_pred, score)`` of each whole text."""
    return docs.select("doc_id", scorer(docs.sparkSession, model)(F.col("text")).alias("language"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = fit(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop what has no language or none that is clear.

    Learned from the stage's own labelled rows; the floor on the posterior only
    meets texts of which no language is likelier than all others together. Where
    nothing could be learned, every text with a letter stays.
    """
    model = fit(docs, fold_of(F.col("doc_id"), 3) != 1)
    if not model.languages:
        return docs.where(lettered(F.col("text")))
    # Rows travel whole in a struct, whatever their columns are called.
    read = docs.select(F.struct(*docs.columns).alias("_row"), scorer(spark, model)(F.col("text")).alias("_language"))
    return read.where((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= 0.5)).select("_row.*")
