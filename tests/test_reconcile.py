import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures import CASES, MATRIX_TEXTS
from labelscope import schemas as S
from labelscope.functions.bpe import pinned_tokenizer
from labelscope.functions.semantic_json import semantic_form
from labelscope.operators import boundary as B
from labelscope.operators import reconcile as R
from labelscope.session import reliable_checkpoint
from labelscope.sources import tables

TOKENIZER = pinned_tokenizer()


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(k, *v) for k, v in CASES.items()]
    rows += [(f"m{i}{j}", s, t, 4) for i, s in enumerate(MATRIX_TEXTS) for j, t in enumerate(MATRIX_TEXTS)]
    return reliable_checkpoint(B.boundary_report(spark.createDataFrame(rows, S.CASES), TOKENIZER))


def test_sound_reports_have_no_violation(stored):
    assert R.report_violations(stored, TOKENIZER).collect() == []


def test_one_pass_vouches_for_sound_attributions_only(stored):
    raw_total = F.col("input_identity.source_codepoints") + F.col("input_identity.target_codepoints")
    sound = R.sound_attribution("full_attribution", "combined_full", raw_total, F.col("input_identity.boundary_codepoint"))
    aligned = stored.where("case_id = 'aligned'")
    bent = lambda **changes: aligned.withColumn("full_attribution", F.transform("full_attribution", lambda t: F.when(
        t["position"] == 1, t.withField(*next(iter(changes.items())))).otherwise(t)))
    longer = aligned.withColumn("full_attribution", F.slice("full_attribution", F.lit(1), F.lit(3)))
    frames = [aligned, longer, bent(ownership=F.lit("target")), bent(ownership=F.lit("nobody")), bent(raw_origins=F.array(F.lit(1), F.lit(0))),
              bent(raw_origins=F.array().cast("array<int>")), bent(raw_origins=F.lit(None).cast("array<int>"))]
    assert [f.select(sound).first()[0] for f in frames] == [True] + [False] * 6


def field(struct, name, value):
    return {struct: F.col(struct).withField(name, value)}


positions = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
MUTATIONS = [
    ("aligned", lambda: {"status": F.lit("fail")}, "report.status"),
    ("aligned", lambda: {"primary_classification": F.lit("boundary_drift")}, "report.primary_classification"),
    ("right-strip-drift", lambda: {"classifications": F.array(F.lit("aligned")), "primary_classification": F.lit("aligned")},
     "report.classifications"),
    ("aligned", lambda: field("legacy_mask", "cutoff", F.lit(3)), "report.legacy_cutoff"),
    ("aligned", lambda: field("legacy_mask", "masked_positions", positions(0)), "report.masked_positions"),
    ("aligned", lambda: field("legacy_mask", "supervised_positions", positions(3)), "report.supervised_positions"),
    ("aligned", lambda: field("legacy_mask", "supervised_positions", positions(1, 2, 3)), "legacy_mask.overlap"),
    ("aligned", lambda: field("diagnostics", "oracle_cutoff", F.lit(3)), "report.oracle_cutoff"),
    ("right-strip-drift", lambda: field("diagnostics", "prompt_leakage_positions", positions()), "report.prompt_leakage"),
    ("aligned", lambda: field("diagnostics", "masked_retained_target_positions", positions(1)), "report.masked_target"),
    ("merge-cross-boundary", lambda: field("diagnostics", "cross_boundary_positions", positions()), "report.cross_boundary_positions"),
    ("aligned", lambda: field("diagnostics", "ambiguous_positions", positions(2)), "report.ambiguous_positions"),
    ("aligned", lambda: field("diagnostics", "full_target_token_count", F.lit(5)), "report.full_target_count"),
    ("aligned", lambda: field("diagnostics", "truncated_target_token_count", F.lit(1)), "report.truncated_target_count"),
    ("target-eliminated", lambda: field("diagnostics", "elimination_causes", F.array().cast("array<string>")), "report.elimination_causes"),
    ("aligned", lambda: field("diagnostics", "indeterminate_reasons", F.array(F.lit("encoding.unknown_token"))), "report.unknown_token_reason"),
    ("normalized-away", lambda: field("diagnostics", "indeterminate_reasons", F.array().cast("array<string>")), "report.target_material"),
    ("aligned", lambda: field("diagnostics", "prompt_leakage_positions", positions(3, 2)), "diagnostics.prompt_leakage_positions"),
    ("aligned", lambda: field("combined_full", "ids", F.array(*map(F.lit, (1, 5, 6, 6))).cast("array<bigint>")), "encoding.token_piece"),
    ("aligned", lambda: field("combined_full", "type_ids", positions(0, 0, 0)), "encoding.length"),
    ("aligned", lambda: field("source_normalization", "nfc_codepoint_count", F.lit(9)), "normalization.counts"),
    ("aligned", lambda: field("source_normalization", "raw_codepoint_count", F.lit(2)), "report.normalization_counts"),
    ("aligned", lambda: field("input_identity", "boundary_codepoint", F.lit(2)), "input.boundary_codepoint"),
    ("aligned", lambda: {"full_attribution": F.transform("full_attribution", lambda t: t.withField("position", t["position"] + 1))},
     "report.full_attribution.positions"),
    ("aligned", lambda: {"full_attribution": F.slice("full_attribution", F.lit(1), F.lit(3))}, "report.full_attribution.length"),
    ("aligned", lambda: {"truncated_attribution": F.transform("truncated_attribution", lambda t: F.when(
        t["position"] == 1, t.withField("ownership", F.lit("target"))).otherwise(t))}, "report.truncated_attribution.ownership"),
]


def test_each_change_is_found(spark, stored):
    union = None
    for i, (case, changes, _) in enumerate(MUTATIONS):
        changed = stored.where(F.col("case_id") == case).withColumns(changes()).withColumn("n", F.lit(i))
        union = changed if union is None else union.unionByName(changed)
    rows = R.revalidate_reports(reliable_checkpoint(union), TOKENIZER).select("n", "first_code", "value_codes", "report_codes").collect()
    got = {r.n: r for r in rows}
    for i, (_, _, code) in enumerate(MUTATIONS):
        assert code in got[i].value_codes + got[i].report_codes, (code, got[i])
        assert got[i].first_code is not None


def test_attestation(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    payloads = {"a.txt": b"one\r\ntwo\rthree\n", "sub/b.bin": bytes(range(256)), "c.txt": b"\n", "d.txt": b"x\n\ny"}
    for name, data in payloads.items():
        (root / name).write_bytes(data)
    inventory = tables.scan_inventory(spark, str(root))
    found = {r.path: r for r in R.file_identities(inventory).collect()}
    assert set(found) == set(payloads)
    for name, data in payloads.items():
        assert found[name].sha256 == hashlib.sha256(data).hexdigest()
        assert found[name].git_blob_sha1 == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
        assert (found[name].byte_length, found[name].line_count) == (len(data), len(data.splitlines()))
    # Empty and hidden files are listed too; the bytes of hidden ones are not read.
    for name, data in (("empty", b""), ("_hidden", b"h"), (".dot", b"")):
        (root / name).write_bytes(data)
    (root / "a.txt").chmod(0o755)
    whole = {r.path: (r.byte_length, r.sha256 is None, r.git_mode) for r in R.file_identities(tables.scan_inventory(spark, str(root))).collect()}
    assert (whole["empty"], whole["_hidden"], whole[".dot"]) == ((0, False, "100644"), (1, True, "100644"), (0, False, "100644"))
    small = tables.scan_inventory(spark, str(root), max_bytes=100)
    before = R.file_identities(inventory).withColumn("git_mode", F.lit("100644"))
    codes = {r.path: r.code for r in R.attest_files(small, before).collect()}
    assert codes["a.txt"] == "file.git_mode" and codes["sub/b.bin"] == "file.unread" and codes["c.txt"] is None
    manifest = R.file_identities(inventory).drop("git_mode").withColumn(
        "sha256", F.when(F.col("path") == "d.txt", "0").otherwise(F.col("sha256"))).where("path <> 'c.txt'").unionByName(
        spark.createDataFrame([("gone", 1, 1, "0", "0")], "path string, byte_length long, line_count long, sha256 string, git_blob_sha1 string"))
    drift = {r.path: r.code for r in R.attest_files(inventory, manifest).collect()}
    assert drift == {"a.txt": None, "sub/b.bin": None, "c.txt": "file.unlisted", "d.txt": "file.sha256", "gone": "file.missing"}


def test_semantic_json():
    assert semantic_form('{"b": 1.50, "a": [-0, 1e9, 12345678901, true, null]}') == '{"a":[0,1E+9,1.2345678901E+10,true,null],"b":1.5}'
    assert semantic_form('{"a":1,"a":2}') is None and semantic_form("[NaN]") is None


def test_expectations(spark):
    have = spark.createDataFrame([("a", "pass", 0), ("b", "fail", 1)], "case_id string, status string, exit int")
    want = spark.createDataFrame([("a", "pass", 0), ("b", "pass", 1), ("c", "fail", 1)], "case_id string, status string, exit int")
    rows = R.check_expectations(have, want, "case_id", ("status", "exit")).collect()
    assert sorted(map(tuple, rows)) == sorted([("b", "status", "pass", "fail"), ("c", "status", "fail", None), ("c", "exit", "1", None)])


def test_manifest_and_training_rows(spark, tmp_path):
    entry = {"path": "a.txt", "byte_length": 2, "line_count": 1, "git_mode": "100644", "sha256": hashlib.sha256(b"a\n").hexdigest(),
             "git_blob_sha1": hashlib.sha1(b"blob 2\x00a\n").hexdigest()}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"schema_version": 1, "kind": "k", "files": [entry, {**entry, "path": "b.txt"}]}, indent=1))
    manifest = tables.read_manifest(spark, str(path))
    assert [r.path for r in manifest.orderBy("path").collect()] == ["a.txt", "b.txt"]
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_bytes(b"a\n")
    bound = R.bind_identity(tables.scan_inventory(spark, str(root)), manifest, "a.txt").collect()
    assert [(r.path, r.code) for r in bound] == [("a.txt", None)]
    spark.createDataFrame([("i", "o", 1)], "instruction string, output string, extra int").write.parquet(str(tmp_path / "sft"))
    rows = tables.read_sft(spark, str(tmp_path / "sft"))
    assert rows.columns == ["instruction", "output"] and rows.count() == 1


def _without(schema, at=()):
    """Every field below ``schema``, as a path of names; ``[]`` steps into an array."""
    for f in schema.fields:
        here = (*at, f.name)
        yield here
        kind = f.dataType
        if isinstance(kind, T.StructType):
            yield from _without(kind, here)
        elif isinstance(kind, T.ArrayType):
            yield (*here, "[]")
            if isinstance(kind.elementType, T.StructType):
                yield from _without(kind.elementType, (*here, "[]"))


def test_every_missing_field_has_a_code(spark, stored):
    row = stored.where("case_id = 'aligned'").first().asDict(recursive=True)

    def cleared(value, path):
        if not path:
            return None
        if path[0] == "[]":
            return [cleared(value[0], path[1:]), *value[1:]] if value else value
        return {**value, path[0]: cleared(value[path[0]], path[1:])}

    def nullable(kind):
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
        return T.ArrayType(nullable(kind.elementType)) if isinstance(kind, T.ArrayType) else kind

    def filled(path):
        value = row
        for step in path:
            value = (value[0] if value else None) if step == "[]" else value[step]
        return value is not None

    paths = [p for p in _without(stored.schema) if filled(p) and p != ("diagnostics", "oracle_cutoff")]
    assert len(paths) > 60
    damaged = spark.createDataFrame([cleared(row, p) for p in paths], nullable(stored.schema)).withColumn("n", F.monotonically_increasing_id())
    got = R.revalidate_reports(reliable_checkpoint(damaged), TOKENIZER).orderBy("n").select("first_code").collect()
    assert [p for p, r in zip(paths, got, strict=True) if r.first_code is None] == []
