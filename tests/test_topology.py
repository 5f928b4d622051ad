import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fixtures import empty_assistant, healthy, typed
from labelscope import schemas as S
from labelscope.operators import topology as L


@pytest.fixture(scope="module")
def traces(spark):
    return spark.createDataFrame([typed(healthy()), typed(empty_assistant())], S.TRACES)


def runs(row):
    return [(r.start, r.end) for r in row]


def test_policy_audits(spark, traces):
    rows = {(r.example_id, r.policy): r for r in L.policy_audits(L.with_policies(traces)).collect()}
    every, reply = rows["healthy-multiturn", "all_tokens"], rows["healthy-multiturn", "assistant_only"]
    assert (every.supervised_token_count, every.boundary_supervised_token_count) == (31, 17)
    assert runs(every.supervised_runs) == [(0, 31)]
    assert (reply.supervised_token_count, reply.ignored_token_count) == (7, 26)
    assert runs(reply.supervised_runs) == [(14, 18), (26, 29)]
    assert every.labels_sha256[:12] == "36eefd068998" and reply.labels_sha256[:12] == "183f9e4db25d"
    silent = rows["empty-assistant-target", "assistant_only"]
    assert silent.supervised_token_count == 0 and silent.supervised_runs == []
    assert silent.labels_sha256[:12] == "cb072ddac889"


def test_audit_report(spark, traces):
    audits = L.audit_traces(traces)
    got = {r.example_id: r for r in audits.collect()}
    assert got["healthy-multiturn"].status == "pass"
    assert got["empty-assistant-target"].diagnostics.asDict() == {
        "empty_assistant_message_indices": [2], "issue_codes": ["assistant_target.empty"]}
    for r in L.audit_report_json(audits).collect():
        again = json.dumps(json.loads(r.report), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert again == r.report
        assert r.audit_sha256 == hashlib.sha256((r.report + "\n").encode()).hexdigest()


def test_trace_digest_ignores_key_order_and_keeps_escapes(spark):
    doc = healthy()
    doc["conversation"]["messages"][0]["content"] = "tab\t bell\x1f \"quoted\" \\u001F é 😀"
    frame = spark.createDataFrame([typed(doc)], S.TRACES)
    want = json.dumps(doc, ensure_ascii=False, separators=(",", ":"), sort_keys=True) + "\n"
    got = frame.select(L.trace_sha256(F.col("example_id"), F.col("messages"), F.col("trace")).alias("d")).first().d
    assert got == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("faults, boundary, off, padding, missing, first", [
    ([(12, "supervise")], [12], [12], [], [], (12, 13)),
    ([(8, "supervise"), (31, "supervise")], [], [8, 31], [31], [], (8, 9)),
    ([(14, "ignore")], [], [], [], [14], (15, 18)),
])
def test_injected_faults(spark, traces, faults, boundary, off, padding, missing, first):
    rows = L.with_policies(traces).where("example_id = 'healthy-multiturn' and policy = 'assistant_only'")
    edits = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(a).alias("action")) for p, a in faults])
    r = L.policy_audits(L.inject_faults(rows, edits)).first()
    assert r.boundary_leakage_positions == boundary and r.off_policy_supervision_positions == off
    assert r.padding_leakage_positions == padding and r.missing_eligible_positions == missing
    assert runs(r.supervised_runs)[0] == first


@pytest.mark.parametrize("labels, code", [
    ([1] * 5, "labels.length"), ([None] + [-100] * 32, "labels.type"), ([5] + [-100] * 32, "labels.token_mismatch"),
    ([-100, None, 7] + [-100] * 30, "labels.type"), ([5, None] + [-100] * 31, "labels.token_mismatch"),
])
def test_unusable_labels(spark, traces, labels, code):
    supplied = spark.createDataFrame([("healthy-multiturn", labels)], "example_id string, labels array<int>")
    r = L.audit_labels(traces, supplied, "assistant_only").first()
    assert r.error_code == code and r.labels_sha256 is None and r.supervised_runs is None


def test_unknown_policy(traces):
    with pytest.raises(ValueError, match="policy.unsupported"):
        L.build_labels(F.col("trace"), F.col("messages"), "everything")


def test_token_grain_agrees_with_row_grain(spark, traces):
    labelled = L.with_policies(traces)
    grain = L.token_grain(labelled.where("policy = 'assistant_only'"), F.col("labels"))
    want = {r.example_id: r.supervised_token_count
            for r in L.policy_audits(labelled).where("policy = 'assistant_only'").collect()}
    got = {r.example_id: r.n for r in grain.groupBy("example_id").agg(
        F.count_if(F.col("label") != -100).alias("n")).collect()}
    assert got == want
    assert grain.where("category is null").count() == 0
