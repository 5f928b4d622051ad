import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import toxicity
from labelscope.llm.registry import registered

SF = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Maximal scoring segments by definition: the best one, then those left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a:b + 1])
            if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                best = (a, b, s)
    if not best:
        return []
    a, b, s = best
    after = [(x + b + 1, y + b + 1, z) for x, y, z in brute_segments(scores[b + 1:])]
    return brute_segments(scores[:a]) + [best] + after


def test_all_maximal_segments_as_by_definition():
    draw = random.Random(2)
    for _ in range(300):
        scores = [draw.choice((-1.0, -1.0, 2.5, 0.75, 1.3)) + draw.random() / 100 * 0 for _ in range(draw.randint(0, 14))]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(np.array(places, int), np.array([scores[i] for i in places]), drift=1.0)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute_segments(scores)))
        for a, b, s in got:
            assert s == pytest.approx(sum(scores[a:b + 1])) and scores[a] > 0 and scores[b] > 0


def test_the_scan_is_linear():
    n = 200_000
    got = toxicity.maximal_segments(np.arange(0, 2 * n, 2), np.full(n, 0.5), drift=1.0)
    assert len(got) == n  # each word stands alone
    assert len(toxicity.maximal_segments(np.arange(n), np.ones(n))) == 1


def test_lambda_and_priors():
    w = toxicity.weigh([b"slurring", b"*slurr", b"plain"], np.array([40.0, 44.0, 5.0]), np.array([0.0, 0.0, 500.0]), 1000, 10_000)
    assert b"plain" not in w.log_odds and w.of(b"Slurring!") > 3
    assert w.of(b"slurrish") == pytest.approx(w.log_odds[b"*slurr"] - toxicity.DRIFT)  # an unseen form leans on the stem
    assert w.of(b"unseen") == -toxicity.DRIFT


def test_held_out_accuracy(spark):
    rows = registered()["op1_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = rows[rows.held_out]
    rank = held.score.rank()
    ones = held.toxic == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.85 and ((held.predicted == 1) & (held.toxic == 0)).sum() <= 1
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()


def test_odd_rows(spark, odd, none):
    docs = odd.where("doc_id is not null").limit(0).unionByName(odd)
    bad = docs.where("doc_id is not null").select((F.col("doc_id") + 100).alias("doc_id"), F.concat(F.lit("you foul wretch you foul wretch "), F.coalesce("text", F.lit(""))).alias("text"))
    every = docs.unionByName(bad, allowMissingColumns=True)
    labels = every.select("doc_id", F.when(F.col("doc_id") > 100, 1).otherwise(0).alias("toxic"), F.lit("x").alias("half"), F.lit(1).alias("text")).unionByName(
        spark.createDataFrame([(None, 1, "x", 1), (1, None, "x", 1)], "doc_id long, toxic int, half string, text int"))
    model = toxicity.fit(every, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score_toxicity(every, model).collect()}
    assert got[3].score == got[4].score == got[5].score < got[106].score  # NULL, empty and blank; a very long one
    assert got[3].passages == [] and got[106].passages[0]["first"] <= 1
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.fit(none, labels, F.lit(True)) is None and toxicity.fit(every, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.score_toxicity(every, None).collect()} == {0.0}
