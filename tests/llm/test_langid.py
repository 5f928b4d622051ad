import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.llm import langid
from labelscope.llm.registry import registered

SF = "/root/testdata/sf0.01"


def test_scores_equal_the_formula(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("aba ab", "x"), ("bcb c", "y"), ("aab", "x"), ("cc bc", "y"), ("cab", "y")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    counts = {k: Counter(b for _, t, own in rows if own == k for w in t.encode().split() for b in langid.ngrams([w])[0].tolist()) for k in "xy"}
    prior = {"x": 2 / 5, "y": 3 / 5}
    for r in langid.predict(docs, model).select("doc_id", "language.*").collect():
        logs = {k: math.log(prior[k]) + sum(
            math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * langid.BUCKETS))
            for w in rows[r.doc_id][1].encode().split() for b in langid.ngrams([w])[0].tolist()) for k in "xy"}
        best = max("xy", key=lambda k: logs[k])
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-4)


def test_held_out_accuracy(spark):
    rows = registered()["op9_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.held_out == rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_odd_rows(spark, odd, none):
    model = langid.fit(odd, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(odd, model).select("doc_id", "language.*").collect()}
    assert [got[i].lang_pred for i in (1, 6, 7, None)] == ["en", "en", "fr", "fr"]
    assert [(got[i].lang_pred, got[i].score) for i in (3, 4, 5, 8)] == [("und", 0.0)] * 4
    assert got[10].lang_pred in ("en", "fr")  # few letters are enough
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, empty).select("language.*").collect()} == {"und"}


def test_stage_keeps_columns_and_clean_rows(spark, odd):
    kept = langid.stage_language(spark, odd, "")
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 6, 7, None} and not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}


def _one_word_languages(spark, count):
    """``count`` languages of one text each, of words that no other has."""
    made = [("".join(chr(0x4E00 + 40 * i + k) for k in (0, 1, 2, 3)) + " " + "".join(chr(0x4E00 + 40 * i + k) for k in (5, 6, 7)), f"l{i:04}") for i in range(count)]
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(made)], "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    docs = _one_word_languages(spark, 520)
    model = langid.fit(docs, F.lit(True))
    assert len(model.languages) == 520
    rows = langid.predict(docs, model).select("doc_id", "language.lang_pred").collect()
    assert all(r.lang_pred == f"l{r.doc_id:04}" for r in rows) and len(rows) == 520


def test_blocks_of_languages_change_nothing(spark, odd, monkeypatch):
    docs = odd.select("doc_id", "text", "lang").union(_one_word_languages(spark, 5).withColumn("doc_id", F.col("doc_id") + 100))
    docs = docs.union(docs.where("lang = 'fr'").withColumn("lang", F.lit("fr-tied")).withColumn("doc_id", F.col("doc_id") + 200))
    found = []
    for at_once in (32, 2):
        monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", at_once)
        model = langid.fit(docs, F.lit(True))
        assert len(model.blocks) == (1 if at_once == 32 else 4)
        found.append(sorted((str(r.doc_id), r.lang_pred, round(r.score, 5)) for r in langid.predict(docs, model).select("doc_id", "language.*").collect()))
    assert found[0] == found[1]


def test_stage_without_labels_keeps_texts_with_letters(spark, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.stage_language(spark, unlabelled, "")
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "10", "2", "6", "7", "9", "None"]
