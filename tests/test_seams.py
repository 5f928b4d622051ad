"""Counts of all pairs of two tables, and sweeps over every length, against the pairs and lengths themselves."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import CASES, MATRIX_COUNTS, MATRIX_TEXTS
from labelscope import schemas as S
from labelscope.functions.bpe import BpeTokenizer, open_text_tokenizer, pinned_tokenizer
from labelscope.operators import seams
from labelscope.operators import sweep as G

MERGES = (("t", "h"), ("th", "e"), ("i", "n"), ("in", "g"), ("e", "r"))
PARTS = ["t", "h", "e", "the", "ing", "er", "i", " ", "  ", "\n", "x", "é", "é", "́", "日", "가", "ᄀ", "ᅡ", "\x1c", "a", "b", ".", "= ̸"]


def brute(spark, sources, targets, tokenizer, lengths):
    """Counts from reports of every pair at every length."""
    pairs = [(f"p{i}", s, t, 8) for i, (s, t) in enumerate(itertools.product(sources, targets))]
    rows = G.input_matrix_counts(spark.createDataFrame(pairs, S.CASES), tokenizer, lengths).collect()
    return {r.classifications: r.cases for r in rows}


def matrix(spark, sources, targets, tokenizer, lengths):
    side = lambda name, texts: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    return {r.classifications: r.cases for r in seams.matrix_counts(side("source", sources), side("target", targets), tokenizer, lengths).collect()}


def test_published_matrix(spark):
    got = matrix(spark, MATRIX_TEXTS, MATRIX_TEXTS, pinned_tokenizer(), (2, 3, 4, 8))
    assert sum(got.values()) == 484
    assert got == brute(spark, MATRIX_TEXTS, MATRIX_TEXTS, pinned_tokenizer(), (2, 3, 4, 8))
    assert got == MATRIX_COUNTS


def texts(seed, count, longest):
    draw = random.Random(seed)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, longest))) for _ in range(count)]
    return made + made[:5]  # equal rows count each


@pytest.mark.parametrize(("seed", "tokenizer"), [
    (1, open_text_tokenizer(MERGES)), (2, pinned_tokenizer()),
    (4, BpeTokenizer(vocab={"<unk>": 0, "<bos>": 1, " ": 2, "t": 3, "h": 4, "e": 5, "th": 6, "a": 7}, merges=(("t", "h"),)))])
def test_random_texts(spark, seed, tokenizer):
    sources, targets, lengths = texts(seed, 20, 12), texts(seed + 50, 20, 12), (2, 3, 5, 9, 14, 30)
    assert matrix(spark, sources, targets, tokenizer, lengths) == brute(spark, sources, targets, tokenizer, lengths)


def test_long_texts_meet_few_seams(spark):
    words = ["the thing", "interest in her", "other", "x"]
    draw = random.Random(9)
    long = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) + draw.choice([".", " ", "t"])
    sources, targets = [long() for _ in range(30)], [long() for _ in range(30)]
    tokenizer = open_text_tokenizer(MERGES)
    assert matrix(spark, sources, targets, tokenizer, (16, 200)) == brute(spark, sources, targets, tokenizer, (16, 200))
    side = lambda name, t: spark.createDataFrame([(x,) for x in t], f"{name} string")
    tails = seams.source_tails(side("source", sources), tokenizer, 204)
    heads = seams.target_heads(side("target", targets), tokenizer, 204)
    assert tails.select("tail").distinct().count() <= 8 and heads.count() <= 10
    assert max(len(r.tail) for r in tails.collect()) <= 6


def test_empty_sides(spark):
    assert matrix(spark, [], ["a"], pinned_tokenizer(), (4,)) == {} == matrix(spark, ["a"], [], pinned_tokenizer(), (4,))


# --- every length ---------------------------------------------------------------


def flat(frame):
    columns = ("case_id", "max_length", "exit_code", "status", "primary_classification", "legacy_cutoff", "oracle_cutoff", "full_target_tokens",
               "retained_target_tokens", "supervised_target_tokens", "truncated_target_tokens", "prompt_leakage_positions",
               "cross_boundary_positions", "elimination_causes", "indeterminate_reasons")
    return Counter(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_intervals_expand_to_the_reports_of_every_length(spark, seed):
    if seed:
        sources, targets = texts(seed, 12, 40), texts(seed + 9, 12, 40)
        rows = [(f"c{i}", s, t, 8) for i, (s, t) in enumerate(zip(sources, targets, strict=True))]
        tokenizer = open_text_tokenizer(MERGES)
    else:
        rows, tokenizer = [(k, *v) for k, v in CASES.items()], pinned_tokenizer()
    cases = spark.createDataFrame(rows, S.CASES)
    lengths = (*range(2, 100), 511, 512)
    intervals = G.sweep_intervals(cases, tokenizer)
    expanded = G.expand_intervals(intervals)
    assert expanded.count() == 511 * len(rows)
    want = flat(G.sweep_table(G.truncation_sweep(cases, tokenizer, lengths)))
    assert flat(expanded.where(F.col("max_length").isin(*lengths))) == want
    asked = spark.createDataFrame([(r[0], n) for r in rows for n in (2, 7, 400)], "case_id string, max_length int")
    assert flat(G.at_lengths(intervals, asked)) == flat(expanded.where(F.col("max_length").isin(2, 7, 400)))
    assert intervals.groupBy("case_id").count().agg(F.max("count")).first()[0] <= 19


def test_intervals_hold_hidden_targets(spark):
    cases = spark.createDataFrame([(k, *v) for k, v in CASES.items()], S.CASES)
    reports = G.truncation_sweep(cases, pinned_tokenizer(), tuple(range(2, 10)))
    want = {(r.case_id, r.max_length): "|".join(map(str, r.p)) for r in reports.select("case_id", "max_length", F.col("diagnostics.masked_retained_target_positions").alias("p")).collect()}
    got = {(r.case_id, r.max_length): r.masked_retained_target_positions for r in G.expand_intervals(G.sweep_intervals(cases, pinned_tokenizer(), 2, 9)).collect()}
    assert got == want
