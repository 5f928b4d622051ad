"""Host-level quality rules.

Each document is held against document rules; failures are counted by host (the
``source`` column), host failure rates are shrunk towards an empirical beta
prior fitted on all hosts by moments, and host verdicts are joined back.

A document is rejected when it fails a base rule, or two soft rules, or one soft
rule on a host whose shrunk failure rate is over ``HOST_LIMIT``. Clean documents
of a bad host stay.

Defined results: a NULL or empty text has no words and fails the base rule; a
NULL host is a host of its own; repeated rows count as often as they occur; an
empty table gives an empty result.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import cut, table, utf8

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
HOST_LIMIT = 0.5
#: Host tables up to this many rows are broadcast; larger ones are joined by salted keys.
BROADCAST_HOSTS = 100_000
SALTS = 64
#: What a code point adds beyond its first byte, and blanks, are no word characters.
_NO_CHARACTER = BLANKS + bytes(range(0x80, 0xC0))


#: An odd multiplier and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer word is taken whole.
_CHUNK = 1 << 20
_IS_BLANK = np.isin(np.arange(256), list(BLANKS))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 2 ** bits of each."""
    grow = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, x, np.uint64)]))
    return grow(_BASE), grow(_INVERSE)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over the bytes: no word is looked at on its own."""
    if len(text) > _CHUNK:
        parts, start = [], 0
        while start < len(text):
            end = min(start + _CHUNK, len(text))
            while end < len(text) and text[end] not in BLANKS:
                end += 1
            parts.append(_hashes(text[start:end]))
            start = end
        return np.concatenate(parts)
    return _hashes(text)


def _hashes(text: bytes) -> np.ndarray:
    codes = np.frombuffer(text, np.uint8)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = _IS_BLANK[codes]
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(max(14, (len(codes) - 1).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers[:len(codes)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverses[starts]
    h ^= (h >> np.uint64(32)) + (ends - starts).astype(np.uint64)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def repeated_words(h: np.ndarray, size: int = 3) -> int:
    """Words inside windows that occur twice or more."""
    w = windows(h, size)
    ordered = np.sort(w)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(w, again)
    covered = np.zeros(len(h), bool)
    for i in range(size):
        covered[i:i + len(w)] |= hit
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    words = word_hashes(text)
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again += line in seen
            seen.add(line)
    return (
        len(words), len(text.translate(None, _NO_CHARACTER)), len(text) - len(text.translate(None, SYMBOLS)),
        again, repeated_words(words), lines,
    )


def counts_column(text: Column) -> Column:
    """``struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines>``."""

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for texts in parts:
            yield pd.DataFrame([text_counts(t) for t in texts.tolist()], columns=names, dtype="int64")

    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(count, COUNTS).asNondeterministic()(utf8(text))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failures() -> Column:
    """How many soft rules a row of counts fails."""
    n = F.col("n_words")
    rules = (
        10 * F.col("n_symbols") > n,
        2 * F.col("n_symbols") > n,
        10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    )
    total = F.lit(0)
    for rule in rules:
        total = total + F.when(rule, 1).otherwise(0)
    return total


def host_verdicts(rows: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed, rate, bad`` from rows of ``host, failed``.

    The beta prior has the mean and variance of the hosts' rates, weighted by
    their documents: three sums over the host table.
    """
    hosts = rows.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("failed"), F.sum(F.col("n_docs") * rate * rate).alias("squares")).first()
    mean = total["failed"] / total["n"] if total["n"] else 0.0
    variance = max(total["squares"] / total["n"] - mean * mean, 1e-6) if total["n"] else 1.0
    # A beta of no less than one document's weight, even when hosts differ wildly.
    strength = max(mean * (1 - mean) / variance - 1, 1.0)
    shrunk = (F.col("n_failed") + strength * mean) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > HOST_LIMIT).alias("bad"))


def with_host_verdict(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``rows`` (with ``host``) and ``host_bad``; ``bad`` holds the bad hosts.

    Bad hosts are broadcast after a check of their number. Beyond it they are
    repeated per salt, so that a hot host's documents spread over ``SALTS`` tasks.
    """
    bad = bad.where("bad").select("host", F.lit(True).alias("host_bad"))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        found = rows.join(F.broadcast(bad.withColumnRenamed("host", "_host")), F.col("host").eqNullSafe(F.col("_host")), "left")
    else:
        salted = bad.select(F.col("host").alias("_host"), "host_bad", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_b"))
        rows = rows.withColumn("_salt_a", (F.rand(7) * SALTS).cast("int"))
        found = rows.join(salted, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_salt_a") == F.col("_salt_b")), "left").drop("_salt_a", "_salt_b")
    return found.drop("_host").withColumn("host_bad", F.coalesce("host_bad", F.lit(False)))


def verdict() -> Column:
    """Kept, from ``base_failed``, ``soft_failed`` and ``host_bad``."""
    return ~F.col("base_failed") & (F.col("soft_failed") < F.when(F.col("host_bad"), 1).otherwise(2))


def judged(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns with counts, host and rule failures of each document."""
    counted = docs.select(*carried, F.col("source").alias("host"), counts_column(F.col("text")).alias("_counts"))
    return counted.select(*carried, "host", "_counts.*").withColumns(
        {"base_failed": base_failed(), "soft_failed": soft_failures()})


def op7_host_quality(spark, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = cut(judged(docs, ["doc_id"]))  # a few numbers a document, read twice
    hosts = host_verdicts(rows.select("host", (F.col("base_failed") | (F.col("soft_failed") > 0)).alias("failed")))
    return with_host_verdict(rows, hosts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict().alias("kept"))


OP7_SQL = """
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, source AS host, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words d LEFT JOIN covered c USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (10 * n_symbols > n_words)::INT + (2 * n_symbols > n_words)::INT + (10 * n_dup_lines > 3 * n_lines)::INT
         + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS soft_failed
  FROM counts),
hosts AS (
  SELECT host, count(*) AS n, sum((base_failed OR soft_failed > 0)::INT) AS f FROM ruled GROUP BY host),
prior AS (
  SELECT sum(f) / sum(n) AS m, greatest(sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2, 1e-6) AS v FROM hosts),
shrunk AS (
  SELECT host, (f + s * m) / (n + s) > 0.5 AS bad
  FROM hosts, (SELECT m, greatest(m * (1 - m) / v - 1, 1.0) AS s FROM prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND soft_failed < CASE WHEN bad THEN 1 ELSE 2 END AS kept
FROM ruled r JOIN shrunk s ON r.host IS NOT DISTINCT FROM s.host
"""


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the host rules keep.

    Two passes over the texts, one for the hosts and one to filter, so that no
    text is shuffled or joined by host.
    """
    failed = judged(docs, []).select("host", (F.col("base_failed") | (F.col("soft_failed") > 0)).alias("failed"))
    bad = cut(host_verdicts(failed).where("bad"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text", "source")
    return with_host_verdict(judged(packed, ["_row"]), bad).where(verdict()).select("_row.*")
