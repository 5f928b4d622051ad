"""What must not grow faster than the input."""

import hashlib
import json
import unicodedata
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from labelscope.functions import unicode
from labelscope.operators import boundary, sweep
from labelscope.plans import queries
from labelscope.sources.tables import write_sweep_csv


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"the énd {c} of {t} " * (3 + c)) for c in range(6) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def joins(plan):
    found = [plan] if plan.nodeName() == "Join" else []
    return found + [x for i in range(plan.children().size()) for x in joins(plan.children().apply(i))]


def test_fixtures_meet_flat_rows_only(spark, tables):
    pairs = queries._pairs(spark, tables)
    fixtures = pairs.select("case_id", F.lit("p").alias("base_fixture_path"), F.lit("s").alias("fixture_raw_sha256"))
    table = sweep.sweep_table(sweep.truncation_sweep(pairs, queries.TOKENIZER, (8, 16)), *queries.IDENTITY, fixtures)
    top = joins(table._jdf.queryExecution().optimizedPlan())[0]
    assert "full_attribution" not in top.children().apply(0).output().toString()
    assert {r.base_fixture_path for r in table.collect()} == {"p"}


@pytest.mark.parametrize("text", ["a", "é" * 5, "plain " * 50 + "é" + " more" * 50, "à̕ x", "가", "क़ ̈́ q"])
def test_provenance_leaves_python_as_runs(spark, text):
    replayed = unicode._replay_one(text)
    _, start, end = unicode._origins(text)
    same = replayed[-2]
    want = [[int(v) if same and v >= 0 else None for v in values] for values in (start, end)] + [unicode._encoder_offsets(text)]
    if not same:
        want[:2] = [[None] * len(unicodedata.normalize("NFC", text))] * 2
    frame = spark.createDataFrame([replayed], unicode._REPLAY_TYPE).select(F.struct("*").alias("r"))
    got = frame.select(*[unicode._unrolled(F.col("r"), name).alias(name) for name in unicode._INDEXES]).first()
    assert [list(got[name]) for name in unicode._INDEXES] == want
    if text.startswith("plain"):
        assert sum(len(part) for part in replayed[1:7]) < 20
    assert unicode._runs(np.array([4, 5, -1, -1, 0, 0])) == ([4, None, 0, 0], [2, 2, 1, 1])


def test_verdicts_are_not_worked_out_again_in_a_filter(spark, tables):
    found = queries.report_violation_rows(spark, tables)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 2000
    assert found.count() > 0


def test_reports_are_stored_as_files(spark, tables):
    stored = queries._stored_reports(spark, tables)
    assert stored.inputFiles() and stored.count() == queries._reports(spark, tables).count()


def test_a_reader_of_stored_reports_unpacks_a_few_at_once(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"one {c} of {t}") for c in range(4) for t in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    stored = queries._stored_reports(spark, str(tmp_path))
    groups = [pq.ParquetFile(urlparse(f).path).metadata for f in stored.inputFiles()]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert max(sizes) <= 32 and sum(sizes) == stored.count() == 120


def test_violations_are_counted_from_small_groups_of_reports(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"one {c} of {t}") for c in range(4) for t in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(queries, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    counted = queries.report_violations(spark, str(tmp_path)).collect()
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("stored/*.parquet")]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert max(sizes) <= 32 and sum(sizes) == sum(r.reports for r in counted) == 120


def found(plan, name):
    here = [plan] if plan.nodeName() == name else []
    return here + [x for i in range(plan.children().size()) for x in found(plan.children().apply(i), name)]


def test_a_sweep_writes_what_no_length_changes_once_a_case(spark):
    texts = [("a", "plain the source", "the target " * 9), ("b", "h\u00e9 \u4e00", "\ue001\x01 \U0001f600 e\u0301 tail"), ("c", "\\u00E9 \"q\" ", "\x1f\n end")]
    cases = spark.createDataFrame(texts, "case_id string, source string, target string")
    reports = sweep.truncation_sweep(cases, queries.TOKENIZER, (4, 16, 64))
    table = sweep.sweep_table(reports, *queries.IDENTITY)
    each = next(g for g in found(table._jdf.queryExecution().optimizedPlan(), "Generate") if "max_length" in g.output().toString())
    assert "_full_attribution_text" in each.output().toString()
    assert not set(boundary.WRITTEN) & set(reports.columns)
    whole = sweep.sweep_table(reports.select("*"), *queries.IDENTITY)
    digests = lambda df: {(r.case_id, r.max_length): r.stdout_sha256 for r in df.collect()}
    assert len(digests(table)) == 9 and digests(table) == digests(whole)
    text = {(r.case_id, r.max_length): r.text for r in reports.select("case_id", "max_length", boundary.report_text(*queries.IDENTITY).alias("text")).collect()}
    assert all(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) == t for t in text.values())
    assert digests(table) == {k: hashlib.sha256((t + "\n").encode()).hexdigest() for k, t in text.items()}


def test_report_text_escapes_and_keeps_nulls(spark, tables):
    odd = "\x01\u00e9\\u00E9\U0001f600"
    reports = queries._reports(spark, tables)
    encoding, tokens = F.col("combined_full"), F.col("full_attribution")
    reports = reports.withColumns({
        "combined_full": encoding.withField("pieces", F.transform("combined_full.pieces", lambda p, i: F.when(i % 3 == 0, F.lit(odd)).when(i % 3 == 1, p))),
        "full_attribution": F.transform(tokens, lambda t: t.withField("ownership", F.lit(odd))), "source_truncated": F.when(F.col("status") == "", F.col("source_truncated")),
        "status": F.lit(odd), "primary_classification": F.lit(None).cast("string"), "classifications": F.array(F.lit(odd), F.lit(None))})
    for row in reports.select(boundary.report_text({"t": odd}, {}).alias("text")).collect():
        read = json.loads(row.text)
        assert json.dumps(read, sort_keys=True, separators=(",", ":")) == row.text
        assert read["encodings"]["source_truncated"] is None and read["encodings"]["combined_full"]["pieces"][:2] == [odd, read["encodings"]["combined_full"]["pieces"][1]]
        assert read["status"] == odd and read["primary_classification"] is None and read["classifications"] == [odd, None] and read["scope"] == {}
        assert {t["ownership"] for t in read["attribution"]["full"]} == {odd} and read["artifact_identity"] == {"t": odd}


def test_a_stored_sweep_shares_the_json_of_a_case(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    written = []
    monkeypatch.setattr(queries, "write_sweep_csv", lambda table, path: (written.append(table), write_sweep_csv(table, path)))
    stored = {(r.case_id, r.max_length): r.stdout_sha256 for r in queries.stored_sweep(spark, tables).collect()}
    each = next(g for g in found(written[0]._jdf.queryExecution().optimizedPlan(), "Generate") if "max_length" in g.output().toString())
    assert "_combined_full_text" in each.output().toString()
    reports = boundary.report_json(queries._sweep(spark, tables).select("*"), *queries.IDENTITY)
    assert len(stored) == 48 and set(stored.values()) == {r.report_sha256 for r in reports.collect()}


def test_report_lines_are_stored_compressed(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    digests = sorted(r.report_sha256 for r in queries.stored_reports(spark, tables).collect())
    folder = f"{tmp_path}/reports/run=1"
    stored = sum(f.stat().st_size for f in tmp_path.glob("reports/run=1/part-*"))
    assert stored < spark.read.text(folder).agg(F.sum(F.octet_length("value"))).first()[0] / 3
    assert digests == sorted(r.report_sha256 for r in queries.report_digests(spark, tables).collect())


def test_damaged_labels_look_for_the_first_target_once_a_trace(spark, tables):
    plan = queries._damaged_audits(spark, tables)._jdf.queryExecution().analyzed().toString()
    assert "= array_min(" not in plan and "array_min(" in plan


def test_provenance_of_a_batch_is_held_in_parts():
    texts = pd.Series(["e\u0301" * (unicode.HELD_CHARS // 4), None, "\u00e9" * 5] * 4)
    parts = list(unicode._replay.func(iter([texts, texts[:0]])))
    assert len(parts) > 2 and sum(map(len, parts)) == len(texts)
    assert [row[0] for part in parts for row in part.itertuples(index=False)] == [t and unicodedata.normalize("NFC", t) for t in texts]
