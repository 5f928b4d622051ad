import json

from pyspark.sql import functions as F

from fixtures import healthy
from labelscope.functions.bpe import pinned_tokenizer
from labelscope.functions.text import PromptTemplate
from labelscope.operators import preprocess as P
from labelscope.streaming import audits as streams

TOKENIZER = pinned_tokenizer()


def test_prompt_layout(spark):
    rows = spark.createDataFrame([("  hi\x1f\n", "out")], "instruction string, output string")
    r = P.render_pairs(rows, PromptTemplate(preamble="  P")).first()
    assert r.source == "P\n### Instruction:\nhi\n### Response:\n" and r.target == "out\n<|EOT|>"


def test_long_source_masks_everything(spark):
    pairs = spark.createDataFrame([("k", "abcd", "e"), ("l", "a", "b")], "k string, source string, target string")
    got = {r.k: r for r in P.preprocess_pairs(pairs, TOKENIZER, max_length=3, keep=("k",)).collect()}
    assert got["k"].input_ids == [1, 14, 5] and got["k"].labels == [-100] * 3
    assert got["l"].input_ids == [1, 14] and got["l"].labels == [-100, -100]


def test_padding_by_batch(spark):
    rows = spark.range(10).select(
        "id", F.expr("transform(sequence(0L, id), x -> x + 5L)").alias("input_ids"),
        F.expr("transform(sequence(0L, id), x -> 1L)").alias("labels"))
    got = {r.id: r for r in P.pad_collate(P.assign_batches(rows, "id", 3, shard_width=4), 0).collect()}
    assert [len(got[i].input_ids) for i in range(10)] == [3, 3, 3, 4, 7, 7, 7, 8, 10, 10]
    assert got[0].input_ids == [5, 0, 0] and got[0].labels == [1, -100, -100]


def test_pad_id_inside_a_row_is_masked_too(spark):
    row = spark.createDataFrame([([5, 0, 7],)], "ids array<bigint>").select(P.attention_mask(F.col("ids"), 0).alias("m"))
    assert row.first().m == [True, False, True]


def test_stream_of_traces(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.jsonl").write_text(json.dumps(healthy()) + "\nnot json\n")
    out, bad, mark = (str(tmp_path / n) for n in ("out", "bad", "mark"))
    streams.write_trace_audits(streams.stream_trace_lines(spark, str(inbox)), out, bad, mark).awaitTermination()
    assert [r.status for r in spark.read.json(out).collect()] == ["pass"]
    assert [r.error_code for r in spark.read.json(bad).collect()] == ["json.invalid"]
