import collections

import corpus_pipeline
import numpy as np
from labelscope.llm import langid, near_dup, packing, quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


def test_stages_and_their_result(spark, tmp_path):
    """The pipeline against its own stages run by hand, and each stage's decision against its operator."""
    assert [f for _, f in corpus_pipeline.STAGES] == [langid.stage_language, quality.stage_quality, near_dup.stage_near_dup, packing.stage_packing]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.count()
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out.write.parquet(folder := str(tmp_path / name.replace(" ", "-")))
        before, docs = docs, spark.read.parquet(folder)
        now = {r.doc_id for r in docs.collect()}
        assert now <= kept and docs.count() == len(now)
        if name == "MinHash near-dedup":
            verdicts = near_dup.near_duplicates(before, 5).where("kept").collect()
            assert now == {r.doc_id for r in verdicts} and len(now) < len(kept)
        kept = now
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == kept
    whole = packed.groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (whole.length == whole.tokens).all()
    # The ids that the pipeline hands out are the tokenizer's, and fill each sequence in order.
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for doc_id, pieces in packed.sort_values("start").groupby("doc_id"):
        ids = np.frombuffer(b"".join(pieces.ids), "<u4").tolist()
        assert ids == [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, packing.END_ID]
    for _, pieces in packed.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == np.cumsum([0, *pieces.length[:-1]]).tolist()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id").where(F.size(F.split("text", r"\s+")) > 60)
    n = clean.count()
    first = langid.stage_language(spark, docs, SF)
    second = quality.stage_quality(spark, first, SF)
    assert clean.join(second, "doc_id", "left_semi").count() > 0.97 * n


def test_empty_and_odd_tables(spark, odd, none, tmp_path):
    for i, docs in enumerate((odd, none)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            docs.write.parquet(path := str(tmp_path / f"{i}-{name.replace(' ', '-')}"))
            docs = spark.read.parquet(path)
        counts = collections.Counter(r.doc_id for r in docs.collect())
        assert max(counts.values(), default=1) == 1
        packing.stage_packing(spark, docs, "").count()
