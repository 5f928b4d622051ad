import json

import pytest
from pyspark.sql import functions as F

from fixtures import CASES, healthy
from labelscope import schemas as S
from labelscope.functions.strict_json import TRACE_RULES, decode_one
from labelscope.operators import contract as V
from labelscope.plans import corpus
from labelscope.sources import documents, tables


def put(path, value):
    def change(doc):
        *parents, last = path
        for step in parents:
            doc = doc[step]
        doc[last] = value
    return change


def drop(path):
    def change(doc):
        *parents, last = path
        for step in parents:
            doc = doc[step]
        del doc[last]
    return change


def both(*changes):
    def change(doc):
        for one in changes:
            one(doc)
    return change


MSG, SEG = ("conversation", "messages"), ("trace", "segments")
roles = lambda *names: [{"role": r, "content": "x"} for r in names]
# (change to the healthy document, code of the first failure)
MUTATIONS = [
    (put(("surprise",), 1), "root.fields"), (drop(("example_id",)), "root.fields"),
    (put((*MSG, 0, "name"), "x"), "message.fields"), (put((*SEG, 0, "token"), "x"), "segment.fields"),
    (put(("schema_version",), True), "schema.version"), (put(("schema_version",), 2), "schema.version"),
    (put(("kind",), "other"), "schema.kind"), (put(("example_id",), "Upper"), "example_id"),
    (put(("example_id",), "x" * 65), "example_id"), (put(("example_id",), ""), "example_id"),
    (put(("conversation",), []), "conversation.type"), (put(("conversation",), {}), "conversation.fields"),
    (put(MSG, {}), "messages.type"), (put(MSG, []), "messages.count"),
    (put(MSG, roles(*["user", "assistant"] * 33)), "messages.count"), (put((*MSG, 1), 5), "message.type"),
    (put((*MSG, 0, "role"), "tool"), "message.role"), (put((*MSG, 0, "role"), 7), "message.role"),
    (put((*MSG, 0, "content"), 3), "message.content_type"), (put((*MSG, 0, "content"), "a\x00b"), "message.content_nul"),
    (put((*MSG, 0, "content"), "\ud800"), "message.content_unicode"),
    (put((*MSG, 0, "content"), "é" * 4097), "message.content_limit"),
    (put(MSG, [{"role": r, "content": "x" * 1025} for r in ["user", "assistant"] * 32]), "messages.content_limit"),
    (put(MSG, roles("system")), "messages.turn_order"), (put(MSG, roles("assistant", "user")), "messages.turn_order"),
    (put(MSG, roles("user", "user", "assistant")), "messages.turn_order"),
    (put(MSG, roles("user", "system", "assistant")), "messages.turn_order"),
    (both(put((*MSG, 1, "content"), "x" * 9000), put((*MSG, 0, "role"), "tool")), "message.role"),
    (put(("trace",), 1), "trace.type"), (drop(("trace", "token_ids")), "trace.fields"),
    (put(("trace", "token_ids"), "x"), "token_ids.type"), (put(("trace", "token_ids"), []), "token_ids.count"),
    (put(("trace", "token_ids"), list(range(4097))), "token_ids.count"),
    (put(("trace", "token_ids", 0), False), "token_ids.item"), (put(("trace", "token_ids", 0), -1), "token_ids.item"),
    (put(("trace", "padding_token_id"), -1), "padding_token_id"), (put(SEG, 1), "segments.type"),
    (drop((*SEG, 17)), "segments.count"), (put((*SEG, 3), 1), "segment.type"), (put((*SEG, 3, "kind"), 1), "segment.kind"),
    (put((*SEG, 3, "message_index"), 64), "segment.message_index"), (put((*SEG, 0, "start"), True), "segment.start"),
    (put((*SEG, 0, "end"), 4097), "segment.end"), (put((*SEG, 1, "kind"), "message_content"), "segments.sequence"),
    (put((*SEG, 1, "message_index"), 1), "segments.sequence"), (put((*SEG, 0, "message_index"), 0), "segments.sequence"),
    (put((*SEG, 1, "start"), 2), "segments.coverage"), (put((*SEG, 0, "end"), 34), "segments.range"),
    (put((*SEG, 17, "end"), 32), "segments.coverage"),
    (both(put((*SEG, 1, "end"), 1), put((*SEG, 2, "start"), 1)), "segments.boundary_empty"),
    (put(("trace", "token_ids", 32), 7), "trace.padding_mismatch"), (put(("trace", "token_ids", 3), 0), None),
]


def raw_frame(spark, payloads):
    rows = [(str(i), bytearray(p), False) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "record_key string, payload binary, oversize boolean")


def codes(frame):
    return [r.error_code for r in sorted(frame.select("record_key", "error_code").collect(), key=lambda r: int(r.record_key))]


def test_one_mutation_one_code(spark):
    payloads = []
    for change, _ in MUTATIONS:
        doc = healthy()
        change(doc)
        payloads.append(json.dumps(doc).encode())
    assert codes(documents.decode_traces(raw_frame(spark, payloads))) == [code for _, code in MUTATIONS]


def test_strict_decoding(spark):
    text = json.dumps(healthy())
    swap = lambda new: text.replace('"schema_version": 1', f'"schema_version": {new}', 1).encode()
    payloads = [
        swap("1.0"), swap("NaN"), swap("9" * 21), swap("2147483648"), swap('1, "schema_version": 1'), b"\xff",
        b" " * (S.TRACE_MAX_BYTES + 1), b"[" * 9 + b"0" + b"]" * 9, json.dumps([0] * 20_001).encode(), b"{", b"3", b"",
    ]
    assert codes(documents.decode_traces(raw_frame(spark, payloads))) == [
        "json.floating_point_forbidden", "json.non_finite_number", "json.integer_out_of_range",
        "json.integer_out_of_range", "json.duplicate_key", "input.utf8", "input.byte_limit", "json.depth_limit",
        "json.node_limit", "json.invalid", "root.type", "json.invalid"]


def test_case_documents(spark):
    base = {"schema_version": S.CASE_SCHEMA_VERSION, "case_id": "a", "source": "x", "target": "y", "max_length": 8}
    changed = [
        ({}, None), ({"max_length": True}, "max_length.type"), ({"max_length": 1}, "max_length.range"),
        ({"max_length": 513}, "max_length.range"), ({"source": ""}, "text.value"), ({"target": "\x00"}, "text.value"),
        ({"target": "\ud800"}, "text.value"), ({"source": "x" * 8193}, "text.size"), ({"case_id": "A"}, "case_id"),
        ({"schema_version": "v2"}, "schema_version"), ({"more": 1}, "document.fields"), ({"max_length": 1234567}, "document.json"),
        ({"source": [[[[1]]]]}, "document.depth"), ({"source": list(range(70))}, "document.nodes"),
    ]
    payloads = [json.dumps({**base, **c}).encode() for c, _ in changed] + [b"", b"[]", b"\xff"]
    assert codes(documents.decode_cases(raw_frame(spark, payloads))) == [c for _, c in changed] + [
        "document.size", "document.root", "document.utf8"]


def test_files_and_lines(spark, tmp_path):
    folder = tmp_path / "cases"
    folder.mkdir()
    for name, (source, target, limit) in CASES.items():
        doc = {"schema_version": S.CASE_SCHEMA_VERSION, "case_id": name, "source": source, "target": target, "max_length": limit}
        (folder / f"{name}.json").write_text(json.dumps(doc))
    (folder / "big.json").write_bytes(b" " * (S.CASE_MAX_BYTES + 1))
    (folder / "empty.json").write_bytes(b"")
    (folder / "_hidden.json").write_bytes(b"{}")
    valid, rejects = documents.read_cases(spark, str(folder))
    assert {r.case_id: (r.source, r.target, r.max_length) for r in valid.collect()} == CASES
    assert {r.record_key.rsplit("/", 1)[1]: r.error_code for r in rejects.collect()} == {
        "big.json": "document.size", "empty.json": "document.size", "_hidden.json": "internal.error"}
    lines = tmp_path / "traces.jsonl"
    lines.write_text(json.dumps(healthy()) + "\n{}\n{}\n")
    valid, rejects = documents.read_traces(spark, str(lines), "lines")
    assert valid.count() == 1 and [r.error_code for r in rejects.collect()] == ["root.fields"] * 2
    assert len({r.record_key for r in rejects.collect()}) == 2  # equal lines keep keys of their own
    assert rejects.columns == ["record_key", "error_code"]


def test_decoder_matches_the_limit_order():
    assert decode_one(b'{"a":1,"a":1.0}', TRACE_RULES)[0] == "json.floating_point_forbidden"


def test_unlisted_codes_are_hidden(spark):
    rows = spark.createDataFrame([("a", "text.value"), ("b", "secret text"), ("c", None)], "k string, error_code string")
    valid, rejects = V.quarantine_split(rows, "k", materialize=True)
    assert [r.k for r in valid.collect()] == ["c"]
    assert {r.k: r.error_code for r in rejects.collect()} == {"a": "text.value", "b": "internal.error"}


def test_hot_conversation_stays_bounded(spark):
    """A third of all turns in one conversation: it is rejected whole, the rest stand."""
    hot = spark.range(3000).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"))
    cold = spark.range(6000).select((1000 + F.floor(F.col("id") / 2)).alias("conv_id"), (F.col("id") % 2).alias("turn"))
    turns = hot.unionByName(cold).select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t "), F.col("turn").cast("string")).alias("text"))
    frame = corpus.assemble_conversations(turns)
    got = {r.error_code: r.n for r in frame.groupBy("error_code").agg(F.count("*").alias("n")).collect()}
    assert got == {None: 3000, "messages.count": 1}
    assert frame.where("conv_id = 7").first().messages is None
    assert corpus.turn_orders(turns).where("error_code is not null").count() == 0
    # Every adjacent pair survives, hot conversation included.
    assert corpus.reply_pairs(turns).count() == 3000 + 1500


def test_sinks(spark, tmp_path):
    reports = spark.createDataFrame([("r1",), ("r2",)], "report string")
    out = tables.write_reports(reports, str(tmp_path / "out"), "1")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["r1", "r2"]
    with pytest.raises(Exception, match="already exists"):
        tables.write_reports(reports, str(tmp_path / "out"), "1")
    sweep = spark.createDataFrame([("a", None, "")], "case_id string, oracle_cutoff int, causes string")
    tables.write_sweep_csv(sweep.coalesce(1), str(tmp_path / "csv"))
    text = [p.read_text() for p in (tmp_path / "csv").glob("*.csv")]
    assert text == ["case_id,oracle_cutoff,causes\na,,\n"]
