import hashlib
import itertools
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from fixtures import CASE_RESULTS, CASES, MATRIX_COUNTS, MATRIX_TEXTS, SWEEP
from labelscope import schemas as S
from labelscope.functions import bpe, unicode as uni
from labelscope.functions.bpe import open_text_tokenizer, pinned_tokenizer
from labelscope.operators import boundary as B
from labelscope.operators import sweep as G


def cases_frame(spark, rows):
    return spark.createDataFrame(rows, S.CASES)


@pytest.fixture(scope="module")
def cases(spark):
    return cases_frame(spark, [(k, *v) for k, v in CASES.items()])


def as_supplied(df):
    """The three encodings as struct columns, the way stored encodings arrive."""
    flat = {f"{n}__{v}" for n in B.ENCODINGS for v in bpe.VECTORS}
    return df.select(*[c for c in df.columns if c not in flat], *[bpe.as_struct(n) for n in B.ENCODINGS])


def test_published_cases(spark, cases):
    seen = {r.case_id: r for r in B.boundary_report(cases, pinned_tokenizer()).collect()}
    for name, (ids, cutoff, oracle, leak, cross, counts, classes) in CASE_RESULTS.items():
        r, d = seen[name], seen[name].diagnostics
        assert r.combined_full.ids == ids
        assert (r.legacy_mask.cutoff, d.oracle_cutoff) == (cutoff, oracle)
        assert (d.prompt_leakage_positions, d.cross_boundary_positions) == (leak, cross)
        assert (d.full_target_token_count, d.retained_target_token_count,
                d.supervised_target_token_count, d.truncated_target_token_count) == counts
        assert r.classifications == classes
        masked, shown = r.legacy_mask.masked_positions, r.legacy_mask.supervised_positions
        assert masked + shown == list(range(len(r.combined_truncated.ids)))
    assert seen["nfc-cross-boundary"].combined_full.offsets == [[0, 0], [0, 1], [2, 3]]
    assert seen["normalized-away"].diagnostics.indeterminate_reasons == ["target.no_attributable_token"]


def test_case_digest(spark, cases):
    # Canonical case document of the composed-accent case, escaped to ASCII.
    row = B.input_identity(cases).where("case_id = 'nfc-cross-boundary'").first()
    assert row.canonical_sha256 == "c1d9ab41a7e3b0ce5cd6f14fd0b119dd9f6ea47d43ce3477cdd3bbab38ae934c"


def test_report_json_is_canonical(spark, cases):
    reports = B.boundary_report(cases, pinned_tokenizer())
    for r in B.report_json(reports, {"z": ["a", "c"], "b": True}, {"s": None}).collect():
        document = json.loads(r.report)
        assert json.dumps(document, separators=(",", ":"), sort_keys=True) == r.report
        assert r.report_sha256 == hashlib.sha256((r.report + "\n").encode()).hexdigest()
        assert document["artifact_identity"] == {"b": True, "z": ["a", "c"]} and document["scope"] == {"s": None}


def test_sweep(spark, cases):
    reports = G.truncation_sweep(cases, pinned_tokenizer())
    grid = {r[0]: ",".join(r[1:]) for r in G.retention_matrix(reports).collect()}
    assert grid == SWEEP


def test_input_matrix(spark):
    sources = spark.createDataFrame([("m", t) for t in MATRIX_TEXTS], "case_id string, source string")
    rows = G.input_matrix_counts(G.input_matrix(sources, MATRIX_TEXTS), pinned_tokenizer(), (2, 3, 4, 8)).collect()
    assert {r.classifications: r.cases for r in rows} == MATRIX_COUNTS


def test_several_classes_keep_precedence(spark):
    rows = [("x", "c ", "d", 3), ("y", "c ", "de", 4), ("z", "aa", "a", 2)]
    got = {r.case_id: r for r in B.boundary_report(cases_frame(spark, rows), pinned_tokenizer()).collect()}
    assert got["x"].classifications == ["target_eliminated", "boundary_drift"]
    assert got["x"].diagnostics.elimination_causes == ["truncation"]
    assert got["y"].classifications == ["partial_target_truncation", "boundary_drift"]
    assert got["z"].classifications == ["target_eliminated"] and got["z"].diagnostics.indeterminate_reasons == []


def test_both_paths_agree(spark):
    """Run-end arithmetic equals following supplied encodings token by token."""
    texts = MATRIX_TEXTS + ["abab é z", "c\x1c", "à̕x", "thé ing"]
    rows = [(f"m{i}", s, t, n) for i, (s, t, n) in enumerate(itertools.product(texts, texts, (2, 4, 9)))]
    cases = cases_frame(spark, rows)
    for tokenizer in (pinned_tokenizer(), open_text_tokenizer((("t", "h"), ("a", "b")))):
        columns = ("case_id", "status", "classifications", "legacy_mask", "diagnostics", "truncated_attribution")
        direct = B.boundary_report(cases, tokenizer).select(*columns).toJSON().collect()
        three = as_supplied(B.three_encodings(cases, tokenizer))
        supplied = B.report_from_encodings(three, tokenizer).select(*columns).toJSON().collect()
        assert sorted(direct) == sorted(supplied)


def altered_report(spark, **fields):
    """The aligned case with one supplied encoding changed."""
    three = as_supplied(B.three_encodings(cases_frame(spark, [("aligned", "c", "de", 8)]), pinned_tokenizer()))
    for name, changes in fields.items():
        column = F.col(name)
        for vector, value in changes.items():
            column = column.withField(vector, value)
        three = three.withColumn(name, column)
    return B.report_from_encodings(three, pinned_tokenizer()).first()


def ints(*values, kind="bigint"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def pairs(*values):
    return F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in values])


def test_not_an_exact_prefix(spark):
    r = altered_report(spark, combined_truncated={"ids": ints(1, 5, 6, 6), "pieces": F.array(*map(F.lit, ["<bos>", "c", "d", "d"]))})
    assert r.classifications == ["indeterminate"]
    assert r.diagnostics.indeterminate_reasons == ["truncation.not_exact_prefix"]
    assert [t.ownership for t in r.truncated_attribution] == ["injected_prefix", "ambiguous", "ambiguous", "ambiguous"]


def test_offset_outside_its_origins(spark):
    bad = {"offsets": pairs((0, 0), (0, 1), (0, 1), (2, 3))}
    r = altered_report(spark, combined_full=bad, combined_truncated=bad)
    assert r.diagnostics.ambiguous_positions == [2]
    assert r.diagnostics.indeterminate_reasons == ["encoding.offset_provenance"]


def test_short_source_is_a_misalignment(spark):
    one = dict(ids=ints(1), pieces=F.array(F.lit("<bos>")), offsets=pairs((0, 0)), type_ids=ints(0, kind="int"),
               special_tokens_mask=ints(1, kind="int"), attention_mask=ints(1, kind="int"))
    r = altered_report(spark, source_truncated=one)
    assert r.classifications == ["indeterminate", "boundary_drift"]
    assert r.diagnostics.indeterminate_reasons == ["encoding.piece_alignment"]


@pytest.mark.parametrize("text, origins, reasons", [
    ("a̕x", [(0, 1), (1, 2), (2, 3)], []),
    ("éx", [(0, 2), (2, 3)], []),
    ("à̕", [None, None], ["normalization.provenance_ambiguous"]),
    ("̈́", [None, None], ["normalization.provenance_ambiguous"]),
    ("가", [None], ["normalization.cluster_replay"]),
])
def test_provenance(spark, text, origins, reasons):
    frame = spark.createDataFrame([(text,)], "t string")
    r = uni.with_normalization(frame, ("t",)).first()
    assert [None if s is None else (s, e) for s, e in zip(r.t_starts, r.t_ends)] == origins
    assert r.t_norm_reasons == reasons and r.t_complete == (not reasons)


def test_right_strip(spark):
    space = [c for c in map(chr, range(1, 0x3100)) if c.isspace()]
    rows = [(" a \t\n", " a"), ("a  ", "a"), ("".join(space), ""), ("a" + "".join(space) + "b", None), ("", "")]
    from labelscope.functions.text import right_strip
    for raw, got in spark.createDataFrame([(r,) for r, _ in rows], "t string").select("t", right_strip(F.col("t"))).collect():
        assert got == raw.rstrip()


def test_inert_ranges_never_change():
    joins = uni._joins_previous()
    for low, high in uni.INERT_RANGES:
        for point in range(low, high + 1):
            char = chr(point)
            assert not unicodedata.combining(char) and char not in joins
            assert unicodedata.normalize("NFC", char) == char


def test_against_a_tokenizer_library(spark):
    """Ids, pieces and offsets equal an independent byte-pair implementation."""
    lib = pytest.importorskip("tokenizers")
    from tokenizers import models, normalizers, processors
    vocab = {"<unk>": 0, "<bos>": 1, **{c: i + 2 for i, c in enumerate("abcdefghinrt eéx")}}
    merges = (("t", "h"), ("th", "e"), ("i", "n"), ("in", "g"), ("a", "a"), ("a", "b"), ("aa", "aa"))
    vocab.update({left + right: 40 + i for i, (left, right) in enumerate(merges)})
    ours = bpe.BpeTokenizer(vocab=vocab, merges=merges)
    theirs = lib.Tokenizer(models.BPE(vocab=vocab, merges=list(merges), unk_token="<unk>", fuse_unk=False))
    theirs.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Strip(left=False, right=True)])
    theirs.post_processor = processors.TemplateProcessing(single="<bos> $A", pair="<bos> $A $B", special_tokens=[("<bos>", 1)])
    texts = ["thethe inging", "aaaaa aab", "a\U0001f600b the", "éx the ẹ́ ", "zz\x1c", "각x",
             "à̕x", "̈́x", "thhe iing\n\n", "aaaaaaaab", "th\ue000e the\ue003"]
    frame = cases_frame(spark, [(f"t{i}", t, "x", 6) for i, t in enumerate(texts)])
    rows = B.three_encodings(frame, ours).select("source", "source_full__ids", "source_full__pieces", "source_full__offsets").collect()
    for r in rows:
        e = theirs.encode(r.source)
        assert r.source_full__ids == e.ids and r.source_full__pieces == e.tokens
        assert [(o.start, o.end) for o in r.source_full__offsets] == e.offsets


def test_merge_table_is_checked():
    with pytest.raises(ValueError):
        bpe.BpeTokenizer(vocab={"abc": 2}, merges=(("ab", "c"),))


@pytest.mark.parametrize("n", [10, 64, 65, 5000])
def test_pieces_on_both_sides_of_the_switch(spark, n):
    """Merges by rule, against an independent library, over whole documents."""
    models = pytest.importorskip("tokenizers.models")
    letters = "etaoinshrdlucmfwygpbvkxqjz"
    two = [(a, b) for a in letters for b in letters]
    merges = (two + [(a + b, c) for a, b in two for c in letters])[:n]
    tokenizer = bpe.open_text_tokenizer(tuple(merges))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("text")
    odd = spark.createDataFrame([("",), (None,), ("theth  \n the\ue000th",), ("et" * 3000,)], "text string")
    rows = docs.union(odd).select("text", tokenizer.pieces(F.col("text")).alias("p"), tokenizer.ids(tokenizer.pieces(F.col("text"))).alias("i")).collect()
    vocab = {c: i for i, c in enumerate(sorted({c for r in rows for c in r.text or ""} | set(letters)))}
    vocab |= {a + b: len(vocab) + i for i, (a, b) in enumerate(merges)}
    library = models.BPE(vocab=vocab, merges=merges)
    for r in rows:
        assert r.p == (None if r.text is None else [t.value for t in library.tokenize(r.text)] if r.text else [])
        if r.text is not None:
            assert r.i == [tokenizer.vocab.get(p, 1024 + ord(p[0])) for p in r.p]


def test_large_vocabulary_lookup(spark):
    vocab = {"<unk>": 0, "<bos>": 1, **{chr(0x4E00 + i): i + 2 for i in range(100)}}
    tokenizer = bpe.BpeTokenizer(vocab=vocab, merges=())
    frame = spark.createDataFrame([("一丁a",)], "t string")
    assert frame.select(tokenizer.ids(tokenizer.pieces(F.col("t"))).alias("i")).first().i == [2, 3, 0]


def test_cases_outside_the_contract_get_no_report(spark):
    rows = [("ok", "ab", "c", 4), ("no-length", "ab", "c", None), ("long", "a" * 9000, "c", 4), ("empty", "", "c", 4), ("short", "ab", "c", 1), ("Bad id", "a", "b", 4)]
    cases = spark.createDataFrame(rows, S.CASES)
    assert [r.case_id for r in B.boundary_report(cases, pinned_tokenizer()).select("case_id").collect()] == ["ok"]


def test_sweep_table_has_every_column(spark):
    cases = spark.createDataFrame([("ok", "ab", "c", 4)], S.CASES)
    fixtures = spark.createDataFrame([("ok", "cases/ok.json", "00")], "case_id string, base_fixture_path string, fixture_raw_sha256 string")
    table = G.sweep_table(G.truncation_sweep(cases, pinned_tokenizer(), (2, 3)), {"t": 1}, {"s": True}, fixtures)
    # The header of the published table.
    assert table.columns == [
        "case_id", "base_fixture_path", "fixture_raw_sha256", "max_length", "canonical_input_sha256", "exit_code", "stdout_sha256",
        "status", "primary_classification", "legacy_cutoff", "oracle_cutoff", "full_target_tokens", "retained_target_tokens",
        "supervised_target_tokens", "truncated_target_tokens", "prompt_leakage_positions", "cross_boundary_positions",
        "elimination_causes", "indeterminate_reasons"]
    reports = B.boundary_report(cases.withColumn("max_length", F.lit(3)), pinned_tokenizer())
    row = table.where("max_length = 3").first()
    assert row.stdout_sha256 == B.report_json(reports, {"t": 1}, {"s": True}).first().report_sha256 and row.fixture_raw_sha256 == "00"
