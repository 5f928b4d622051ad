"""Re-derive stored reports and files and report every disagreement."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.arrays import compact_codes, int_range, let, positions_where
from labelscope.functions.canonical import git_blob_sha1, line_count

_MAX_CODEPOINTS = 8 * 1024


def _increasing(values: Column) -> Column:
    return let(values, lambda v: ~F.exists(
        F.transform(v, lambda x, i: (x < 0) | (F.when(i > 0, F.get(v, i - 1)) >= x)), lambda bad: F.coalesce(bad, F.lit(False))))


def _ordered_subset(values: Column, order: tuple[str, ...]) -> Column:
    """Distinct, known, and in the order given."""
    known = F.array(*map(F.lit, order))
    return let(values, lambda v: v.eqNullSafe(F.filter(known, lambda k: F.array_contains(v, k))))


def encoding_rules(name: str, tokenizer) -> list[tuple[Column, str]]:
    """Rules one encoding must satisfy on its own."""
    c = lambda v: F.col(f"{name}.{v}")
    n = F.size(c("ids"))
    vectors = ("pieces", "offsets", "type_ids", "special_tokens_mask", "attention_mask")
    same_length = n >= 1
    for v in vectors:
        same_length = same_length & (F.size(c(v)) == n)
    body = lambda v: F.slice(c(v), F.lit(2), F.size(c(v)))
    start, end = (lambda o: F.get(o, F.lit(0))), (lambda o: F.get(o, F.lit(1)))
    named = F.zip_with(c("pieces"), tokenizer.shown(c("ids"), c("pieces")), lambda p, s: p.eqNullSafe(s))
    relookup = F.zip_with(
        tokenizer.ids(body("pieces")), body("ids"), lambda want, got: want.eqNullSafe(got) | (got == tokenizer.unknown_id))
    unordered = let(body("offsets"), lambda o: F.exists(
        F.transform(o, lambda x, i: F.when(i > 0, (start(F.get(o, i - 1)) > start(x)) | (end(F.get(o, i - 1)) > end(x)))
                    .otherwise(False)), lambda bad: bad))
    return [
        (~F.forall(c("ids"), lambda i: i.isNotNull() & (i >= 0)), "encoding.ids"),
        (F.exists(c("pieces"), lambda p: p.isNull() | (p == "")), "encoding.pieces"),
        (same_length & (~F.forall(named, lambda ok: ok) | ~F.forall(relookup, lambda ok: ok)), "encoding.token_piece"),
        (F.exists(c("offsets"), lambda o: (F.size(o) != 2) | (start(o) < 0) | (start(o) > end(o)))
         | F.exists(body("offsets"), lambda o: start(o) == end(o)), "encoding.offsets"),
        (F.exists(c("type_ids"), lambda t: t != 0), "encoding.type_ids"),
        (F.exists(c("special_tokens_mask"), lambda t: ~t.isin(0, 1)), "encoding.special_tokens_mask"),
        (F.exists(c("attention_mask"), lambda t: t != 1), "encoding.attention_mask"),
        (~same_length, "encoding.length"),
        ((F.get(c("ids"), F.lit(0)) != tokenizer.bos_id) | (F.get(c("pieces"), F.lit(0)) != tokenizer.bos_piece)
         | (F.get(c("offsets"), F.lit(0)) != F.array(F.lit(0), F.lit(0)))
         | (F.get(c("special_tokens_mask"), F.lit(0)) != 1)
         | F.exists(body("special_tokens_mask"), lambda t: t != 0), "encoding.special_layout"),
        (unordered, "encoding.offset_order"),
    ]


def normalization_rules(name: str) -> list[tuple[Column, str]]:
    c = lambda f: F.col(f"{name}.{f}")
    cross = c("cross_boundary_output_positions")
    count = c("normalized_codepoint_count")
    return [
        (count + c("trailing_normalized_codepoints_removed") != c("nfc_codepoint_count"), "normalization.counts"),
        ((c("raw_codepoint_count") > 2 * _MAX_CODEPOINTS) | (c("nfc_codepoint_count") > 8 * _MAX_CODEPOINTS),
         "normalization.bounds"),
        (~_increasing(cross) | (F.coalesce(F.array_max(cross) >= count, F.lit(False))),
         "normalization.cross_boundary_positions"),
    ]


def sound_attribution(name: str, encoding: str, raw_count: Column, boundary: Column) -> Column:
    """True only where no rule on single tokens can be broken: origins are the whole offsets, owners follow from them.

    One pass over the tokens. Where it is false, :func:`attribution_rules` say what is wrong, if anything is.
    """
    zipped = F.arrays_zip(
        F.col(name).alias("t"), F.col(f"{encoding}.special_tokens_mask").alias("special"), F.col(f"{encoding}.offsets").alias("o"))

    def sound(z: Column, x: Column) -> Column:
        owner, origins = z["t"]["ownership"], z["t"]["raw_origins"]
        start, end = F.get(z["o"], F.lit(0)), F.get(z["o"], F.lit(1))
        wanted = F.when((start < x["b"]) & (end > x["b"]), "cross_boundary").when(start < x["b"], "source").otherwise("target")
        whole = (start >= 0) & (start < end) & (end <= x["n"]) & (z["special"] != 1) & (owner == wanted)
        bare = F.when(owner == "injected_prefix", z["special"] == 1).otherwise((owner == "ambiguous") & (z["special"] != 1))
        return F.when(F.size(origins) > 0, whole & (origins == F.sequence(start, end - 1))).otherwise(bare & (F.size(origins) == 0))

    return F.coalesce(let(F.struct(raw_count.alias("n"), boundary.alias("b")), lambda x: F.forall(zipped, lambda z: F.coalesce(sound(z, x), F.lit(False)))), F.lit(False))


def origins_unordered(name: str) -> Column:
    """Some token's origins do not follow those of the token with origins before it."""
    low, high = (lambda t: F.array_min(t["raw_origins"])), (lambda t: F.array_max(t["raw_origins"]))
    with_origins = F.filter(name, lambda t: F.size(t["raw_origins"]) > 0)
    return let(with_origins, lambda w: F.exists(
        F.transform(w, lambda t, i: F.when(i > 0, high(F.get(w, i - 1)) >= low(t)).otherwise(False)), lambda bad: bad))


def attribution_rules(
    name: str, encoding: str, raw_count: Column, boundary: Column, sound: Column, unordered: Column
) -> list[tuple[Column, str]]:
    """Positions, origins and ownership of one attribution vector.

    ``sound`` and ``unordered`` are columns with :func:`sound_attribution` and :func:`origins_unordered`;
    single tokens are looked at rule by rule only where they are not sound.
    """
    tokens = F.col(name)
    code = f"report.{name}"
    zipped = F.arrays_zip(
        tokens.alias("t"), F.col(f"{encoding}.special_tokens_mask").alias("special"),
        F.col(f"{encoding}.offsets").alias("o"))

    def any_token(test) -> Column:
        return ~sound & let(F.struct(raw_count.alias("n"), boundary.alias("b")), lambda x: F.exists(
            zipped, lambda z: F.coalesce(test(z["t"], z["special"], z["o"], x), F.lit(False))))

    origins = lambda t: t["raw_origins"]
    low, high = (lambda t: F.array_min(origins(t))), (lambda t: F.array_max(origins(t)))
    inside = lambda t, o, x: (
        (F.get(o, F.lit(0)) >= 0) & (F.get(o, F.lit(0)) < F.get(o, F.lit(1))) & (F.get(o, F.lit(1)) <= x["n"])
        & (F.size(F.array_except(F.sequence(F.get(o, F.lit(0)), F.greatest(F.get(o, F.lit(0)), F.get(o, F.lit(1)) - 1)),
                                 origins(t))) == 0))
    owned = lambda t: t["ownership"].isin("source", "target", "cross_boundary")
    owner = lambda t, x: F.when((low(t) < x["b"]) & (high(t) >= x["b"]), "cross_boundary").when(
        low(t) < x["b"], "source").otherwise("target")
    positions = F.exists(F.transform(tokens, lambda t, i: t["position"] != i), lambda bad: bad)
    return [
        (~sound & F.exists(tokens, lambda t: ~t["ownership"].isin(*S.OWNERSHIPS)), "attribution.ownership"),
        (any_token(lambda t, s, o, x: (t["ownership"] == "injected_prefix") & (F.size(origins(t)) > 0)),
         "attribution.injected_origins"),
        (any_token(lambda t, s, o, x: (owned(t) & (F.size(origins(t)) == 0)) | ~_increasing(origins(t))),
         "attribution.raw_origins"),
        (F.size(tokens) != F.size(f"{encoding}.ids"), f"{code}.length"),
        (positions, f"{code}.positions"),
        (any_token(lambda t, s, o, x: high(t) >= x["n"]), f"{code}.raw_origins"),
        (any_token(lambda t, s, o, x: (s == 1) != (t["ownership"] == "injected_prefix")), f"{code}.special"),
        (any_token(lambda t, s, o, x: (owned(t) & (owner(t, x) != t["ownership"]))
                   | ((t["ownership"] == "ambiguous") & (F.size(origins(t)) > 0) & inside(t, o, x))), f"{code}.ownership"),
        (any_token(lambda t, s, o, x: owned(t) & ~inside(t, o, x)), f"{code}.offset"),
        # Whole offsets that follow each other share nothing.
        (~(sound & ~F.coalesce(unordered, F.lit(True))) & (F.size(F.array_distinct(F.flatten(F.transform(tokens, origins)))) != F.size(F.flatten(F.transform(tokens, origins)))),
         f"{code}.origin_overlap"),
        (unordered, f"{code}.origin_order"),
    ]


#: Every stored field, by the section whose name its code carries. Only ``oracle_cutoff`` may be NULL.
_COUNTS = ("raw_codepoint_count", "nfc_codepoint_count", "normalized_codepoint_count", "trailing_normalized_codepoints_removed")
_POSITIONS = ("prompt_leakage_positions", "masked_retained_target_positions", "cross_boundary_positions", "ambiguous_positions")
_TARGET_COUNTS = ("full_target_token_count", "retained_target_token_count", "supervised_target_token_count", "truncated_target_token_count")
_VECTORS = ("ids", "pieces", "offsets", "type_ids", "special_tokens_mask", "attention_mask")
_SCALARS = {
    "input_identity": ("input", ("case_id", "canonical_sha256", "source_codepoints", "target_codepoints", "boundary_codepoint", "max_length")),
    "source_normalization": ("normalization", (*_COUNTS, "provenance_complete")),
    "combined_normalization": ("normalization", (*_COUNTS, "provenance_complete")),
    "legacy_mask": ("legacy_mask", ("algorithm", "cutoff")),
    "diagnostics": ("diagnostics", _TARGET_COUNTS),
}
_LISTS = {
    "source_normalization": ("normalization", ("cross_boundary_output_positions",)),
    "combined_normalization": ("normalization", ("cross_boundary_output_positions",)),
    "source_truncated": ("encoding", _VECTORS), "combined_full": ("encoding", _VECTORS), "combined_truncated": ("encoding", _VECTORS),
    "legacy_mask": ("legacy_mask", ("masked_positions", "supervised_positions")),
    "diagnostics": ("diagnostics", (*_POSITIONS, "elimination_causes", "indeterminate_reasons")),
}


def presence_rules() -> list[tuple[Column, str]]:
    """A rule for each field that must be there, its elements included."""
    incomplete = lambda values: values.isNull() | F.coalesce(F.exists(values, lambda x: x.isNull()), F.lit(False))
    rules = [(F.col(f).isNull(), f"report.{f}") for f in ("case_id", "max_length", "status", "primary_classification")]
    rules.append((incomplete(F.col("classifications")), "report.classifications"))
    for section, (prefix, fields) in _SCALARS.items():
        rules += [(F.col(f"{section}.{f}").isNull(), f"{prefix}.{f}") for f in fields]
    for section, (prefix, fields) in _LISTS.items():
        rules += [(incomplete(F.col(f"{section}.{f}")), f"{prefix}.{f}") for f in fields]
    for section in ("source_truncated", "combined_full", "combined_truncated"):
        bent = F.exists(f"{section}.offsets", lambda o: (F.size(o) != 2) | F.exists(o, lambda x: x.isNull()))
        rules.append((F.coalesce(bent, F.lit(False)), "encoding.offsets"))
    for section in ("full_attribution", "truncated_attribution"):
        tokens = F.col(section)
        rules.append((incomplete(tokens), f"report.{section}"))
        absent = lambda f, tokens=tokens: F.coalesce(F.exists(tokens, lambda t: t[f].isNull()), F.lit(False))
        rules += [(absent(f), f"attribution.{f}") for f in ("ownership", "position")]
        rules.append((F.coalesce(F.exists(tokens, lambda t: incomplete(t["raw_origins"])), F.lit(False)), "attribution.raw_origins"))
    return rules


def validate_report_values(reports: DataFrame, tokenizer) -> DataFrame:
    """Adds ``value_codes``: field-level rules broken by each report.

    Presence comes first: a report with a missing field is judged by that alone,
    so no later rule compares with NULL.
    """
    identity, mask, d = (lambda f, p=p: F.col(f"{p}.{f}") for p in ("input_identity", "legacy_mask", "diagnostics"))
    rules = [
        (~F.coalesce(identity("case_id").rlike(S.ID_PATTERN), F.lit(False)), "input.case_id"),
        (~F.coalesce(identity("canonical_sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), "input.canonical_sha256"),
        (identity("source_codepoints") <= 0, "input.source_codepoints"),
        (identity("target_codepoints") <= 0, "input.target_codepoints"),
        ((identity("source_codepoints") > _MAX_CODEPOINTS) | (identity("target_codepoints") > _MAX_CODEPOINTS),
         "input.codepoint_bounds"),
        (identity("boundary_codepoint") != identity("source_codepoints"), "input.boundary_codepoint"),
        (~identity("max_length").between(S.MIN_MODEL_LENGTH, S.MAX_MODEL_LENGTH), "input.max_length"),
        *[(F.col(f"{s}.{f}") < 0, f"normalization.{f}") for s in ("source_normalization", "combined_normalization") for f in _COUNTS],
        *normalization_rules("source_normalization"), *normalization_rules("combined_normalization"),
        *encoding_rules("source_truncated", tokenizer), *encoding_rules("combined_full", tokenizer),
        *encoding_rules("combined_truncated", tokenizer),
        (mask("algorithm") != S.MASK_ALGORITHM, "legacy_mask.algorithm"),
        (mask("cutoff") < 0, "legacy_mask.cutoff"),
        (~_increasing(mask("masked_positions")), "legacy_mask.masked_positions"),
        (~_increasing(mask("supervised_positions")), "legacy_mask.supervised_positions"),
        (F.arrays_overlap(mask("masked_positions"), mask("supervised_positions")), "legacy_mask.overlap"),
        (d("oracle_cutoff") < 0, "diagnostics.oracle_cutoff"),
        *[(~_increasing(d(f)), f"diagnostics.{f}") for f in (
            "prompt_leakage_positions", "masked_retained_target_positions",
            "cross_boundary_positions", "ambiguous_positions")],
        *[(d(f) < 0, f"diagnostics.{f}") for f in (
            "full_target_token_count", "retained_target_token_count",
            "supervised_target_token_count", "truncated_target_token_count")],
        (~_ordered_subset(d("elimination_causes"), S.ELIMINATION_CAUSES), "diagnostics.elimination_causes"),
        (~_ordered_subset(d("indeterminate_reasons"), S.INDETERMINATE_REASONS), "diagnostics.indeterminate_reasons"),
    ]
    missing = reports.withColumn("missing_codes", F.array_distinct(compact_codes(*presence_rules())))
    values = F.array_distinct(compact_codes(*rules))
    return missing.withColumn("value_codes", F.when(F.size("missing_codes") > 0, F.col("missing_codes")).otherwise(values))


def revalidate_reports(reports: DataFrame, tokenizer) -> DataFrame:
    """Adds ``value_codes``, ``report_codes`` and ``first_code``.

    Every derived field is recomputed from the encodings, attribution and mask
    and compared with the stored one; codes keep the order of the checks.
    """
    out = validate_report_values(reports, tokenizer)
    d = lambda f: F.col(f"diagnostics.{f}")
    raw_total = F.col("input_identity.source_codepoints") + F.col("input_identity.target_codepoints")
    boundary = F.col("input_identity.boundary_codepoint")
    source_size = F.size("source_truncated.ids")
    kept = F.size("combined_truncated.ids")
    cut = F.least(source_size, kept)
    owner_at = lambda name, owner, test=None: positions_where(
        F.transform(name, lambda t: t["ownership"]),
        (lambda o, i: (o == owner) & test(i)) if test else (lambda o, i: o == owner))
    supervised = F.col("legacy_mask.supervised_positions")
    masked = F.col("legacy_mask.masked_positions")
    # Positions are distinct, so an intersection finds those inside in one pass.
    out = out.withColumns({
        "_leak": F.array_intersect(owner_at("truncated_attribution", "source"), supervised),
        "_hidden": F.array_intersect(owner_at("truncated_attribution", "target"), masked),
        "_cross": owner_at("full_attribution", "cross_boundary"),
        "_unclear": owner_at("full_attribution", "ambiguous"),
        "_full": F.size(owner_at("full_attribution", "target")),
        "_kept_targets": owner_at("truncated_attribution", "target"),
        "_kept_unclear": owner_at("truncated_attribution", "ambiguous"),
    })
    first_target = F.array_min("_kept_targets")
    oracle = F.when(~F.coalesce(F.array_min("_kept_unclear") < first_target, F.lit(False)), first_target)
    reason = lambda code: F.array_contains(d("indeterminate_reasons"), code)
    piece_chars = lambda e: F.char_length(F.array_join(F.slice(F.col(f"{e}.pieces"), F.lit(2), F.size(f"{e}.ids")), ""))
    same_prefix = F.lit(True)
    for v in ("ids", "pieces", "offsets", "type_ids", "special_tokens_mask", "attention_mask"):
        same_prefix = same_prefix & (
            F.slice(F.col(f"combined_full.{v}"), F.lit(1), kept) == F.col(f"combined_truncated.{v}"))
    unknown = F.lit(False)
    for e in ("source_truncated", "combined_full", "combined_truncated"):
        unknown = unknown | F.array_contains(F.col(f"{e}.ids"), F.lit(tokenizer.unknown_id).cast("bigint"))
    source_norm, combined_norm = (F.col(f"{n}_normalization.normalized_codepoint_count") for n in ("source", "combined"))
    out = out.withColumns({
        "_oracle": oracle,
        "_prefix": same_prefix & (kept <= F.size("combined_full.ids")),
        "_unknown": unknown,
        "_source_mismatch": (piece_chars("source_truncated") > source_norm)
        | ((source_size < F.col("max_length")) & (piece_chars("source_truncated") != source_norm)),
        "_combined_mismatch": piece_chars("combined_full") != combined_norm,
        "_incomplete": ~F.col("source_normalization.provenance_complete")
        | ~F.col("combined_normalization.provenance_complete"),
        "_shown": F.size(F.array_intersect("_kept_targets", supervised)),
        "_shown_unclear": F.arrays_overlap("_kept_unclear", supervised),
        **{f"_{part}_sound": sound_attribution(f"{part}_attribution", f"combined_{part}", raw_total, boundary) for part in ("full", "truncated")},
        **{f"_{part}_unordered": origins_unordered(f"{part}_attribution") for part in ("full", "truncated")},
    })
    zipped = F.arrays_zip(F.col("full_attribution").alias("t"), F.col("combined_full.offsets").alias("o"))
    offset_issue = let(raw_total, lambda n: F.exists(zipped, lambda z: F.coalesce(
        (z["t"]["ownership"] == "ambiguous") & (F.size(z["t"]["raw_origins"]) > 0) & ~(
            (F.get(z["o"], F.lit(0)) < F.get(z["o"], F.lit(1))) & (F.get(z["o"], F.lit(1)) <= n)
            & (F.get(z["o"], F.lit(0)) >= F.array_min(z["t"]["raw_origins"]))
            & (F.get(z["o"], F.lit(1)) <= F.array_max(z["t"]["raw_origins"]) + 1)), F.lit(False))))
    unclear_without_origin = F.exists(
        "full_attribution", lambda t: (t["ownership"] == "ambiguous") & (F.size(t["raw_origins"]) == 0))
    misaligned = F.col("_source_mismatch") | F.col("_combined_mismatch") | (
        F.col("combined_normalization.provenance_complete") & ~F.col("_unknown") & unclear_without_origin)
    unproven = reason("truncation.not_exact_prefix")
    retained, full, shown = F.size("_kept_targets"), F.col("_full"), F.col("_shown")
    eliminated = ~unproven & (full > 0) & (shown == 0) & ~F.col("_shown_unclear")
    absent = (full == 0) & (F.size("_cross") == 0) & (F.size("_unclear") == 0)
    no_reasons = F.size(d("indeterminate_reasons")) == 0
    drift = (F.size(d("prompt_leakage_positions")) > 0) | (F.size(d("masked_retained_target_positions")) > 0) | F.coalesce(
        d("oracle_cutoff") != F.col("legacy_mask.cutoff"), F.lit(False))
    stored = lambda f, want: ~d(f).eqNullSafe(want)
    classes = compact_codes(
        (~no_reasons | (F.size(d("ambiguous_positions")) > 0), "indeterminate"),
        (F.size(d("cross_boundary_positions")) > 0, "cross_boundary_token"),
        (eliminated, "target_eliminated"),
        (~unproven & (d("retained_target_token_count") > 0)
         & (d("retained_target_token_count") < d("full_target_token_count")), "partial_target_truncation"),
        (~unproven & drift, "boundary_drift"),
    )
    want_classes = let(classes, lambda c: F.when(F.size(c) == 0, F.array(F.lit("aligned"))).otherwise(c))
    primary = F.get("classifications", F.lit(0))
    offsets_outside = F.exists(F.slice(F.col("source_truncated.offsets"), F.lit(2), source_size), lambda o: ~(
        (F.get(o, F.lit(0)) < F.get(o, F.lit(1))) & (F.get(o, F.lit(1)) <= boundary)))
    want_status = F.when(primary == "indeterminate", "indeterminate").when(primary == "aligned", "pass").otherwise("fail")
    rules = [
        (~F.col("status").isin(*S.STATUSES), "report.status"),
        (~F.col("primary_classification").isin(*S.CLASSIFICATIONS)
         | ~F.col("primary_classification").eqNullSafe(primary), "report.primary_classification"),
        (~_ordered_subset(F.col("classifications"), S.CLASSIFICATIONS), "report.classifications"),
        ((F.col("source_normalization.raw_codepoint_count") != boundary)
         | (F.col("combined_normalization.raw_codepoint_count") != raw_total), "report.normalization_counts"),
        (F.size("source_normalization.cross_boundary_output_positions") > 0, "report.source_cross_boundary"),
        (offsets_outside, "report.source_offsets"),
        ((source_size > F.col("max_length")) | (kept > F.col("max_length")), "report.truncation_length"),
        (F.col("legacy_mask.cutoff") != source_size, "report.legacy_cutoff"),
        (~masked.eqNullSafe(int_range(0, cut)), "report.masked_positions"),
        (~supervised.eqNullSafe(int_range(cut, kept)), "report.supervised_positions"),
        *attribution_rules("full_attribution", "combined_full", raw_total, boundary, F.col("_full_sound"), F.col("_full_unordered")),
        *attribution_rules("truncated_attribution", "combined_truncated", raw_total, boundary, F.col("_truncated_sound"), F.col("_truncated_unordered")),
        (F.col("_prefix") & unproven, "report.encoding_prefix_reason"),
        (F.col("_prefix") & (F.col("truncated_attribution") != F.slice("full_attribution", F.lit(1), kept)),
         "report.attribution_prefix"),
        (~F.col("_prefix") & ~unproven, "report.encoding_prefix"),
        (stored("prompt_leakage_positions", F.col("_leak")), "report.prompt_leakage"),
        (stored("masked_retained_target_positions", F.col("_hidden")), "report.masked_target"),
        (stored("cross_boundary_positions", F.col("_cross")), "report.cross_boundary_positions"),
        (stored("ambiguous_positions", F.col("_unclear")), "report.ambiguous_positions"),
        (stored("oracle_cutoff", F.col("_oracle")), "report.oracle_cutoff"),
        (F.col("_unknown") != reason("encoding.unknown_token"), "report.unknown_token_reason"),
        ((misaligned & ~reason("encoding.piece_alignment"))
         | (reason("encoding.piece_alignment") & ~misaligned & ~F.col("_incomplete")), "report.piece_alignment_reason"),
        (offset_issue != reason("encoding.offset_provenance"), "report.offset_reason"),
        (F.col("_incomplete") != (reason("normalization.cluster_replay") | reason("normalization.provenance_ambiguous")
                                  | reason("normalization.runtime_mismatch")), "report.normalization_reason"),
        ((F.size("_unclear") > 0) & no_reasons, "report.ambiguous_reason"),
        (reason("normalization.runtime_mismatch") & ~F.col("_incomplete"), "report.runtime_mismatch_reason"),
        ((F.size("combined_normalization.cross_boundary_output_positions") > 0) & (F.size("_cross") == 0) & no_reasons,
         "report.normalization_cross_boundary"),
        (stored("full_target_token_count", full), "report.full_target_count"),
        (stored("retained_target_token_count", retained), "report.retained_target_count"),
        (stored("supervised_target_token_count", shown), "report.supervised_target_count"),
        (retained > full, "report.target_count_order"),
        (stored("truncated_target_token_count", full - retained), "report.truncated_target_count"),
        (stored("elimination_causes", F.when(eliminated, compact_codes(
            (retained < full, "truncation"), (retained > 0, "legacy_cutoff"))).otherwise(F.array().cast("array<string>"))),
         "report.elimination_causes"),
        (absent != reason("target.no_attributable_token"), "report.target_material"),
        (no_reasons & (F.col("_source_mismatch") | F.col("_combined_mismatch")), "report.normalized_piece_count"),
        (~F.col("classifications").eqNullSafe(want_classes), "report.classifications"),
        (F.col("status") != want_status, "report.status"),
    ]
    out = out.withColumn("report_codes", F.when(
        F.size("missing_codes") == 0, F.array_distinct(compact_codes(*rules))).otherwise(F.array().cast("array<string>")))
    out = out.drop("missing_codes", *[c for c in out.columns if c.startswith("_")])
    return out.withColumn("first_code", F.get(F.concat("value_codes", "report_codes"), F.lit(0)))


def report_violations(reports: DataFrame, tokenizer) -> DataFrame:
    """One row ``case_id, max_length, code`` per broken rule."""
    checked = revalidate_reports(reports, tokenizer)
    return checked.select("case_id", "max_length", F.explode(F.concat("value_codes", "report_codes")).alias("code"))


# --- files and golden tables --------------------------------------------------


def file_identities(inventory: DataFrame) -> DataFrame:
    """``path, byte_length, line_count, sha256, git_blob_sha1`` of ``path, content``.

    A length that the inventory lists (``bytes``) counts where the content was not
    read; the other identities are NULL there. ``git_mode`` is passed on.
    """
    content = F.col("content")
    length = F.octet_length(content).cast("bigint")
    if "bytes" in inventory.columns:
        length = F.coalesce(length, F.col("bytes"))
    return inventory.select(
        "path", *(c for c in inventory.columns if c == "git_mode"), length.alias("byte_length"), line_count(content).alias("line_count"),
        F.sha2(content, 256).alias("sha256"), git_blob_sha1(content).alias("git_blob_sha1"),
    )


def artifact_manifest(inventory: DataFrame) -> DataFrame:
    """``path, bytes, sha256`` per file; where the content was not read, the listed length and no hash."""
    return file_identities(inventory).select("path", F.col("byte_length").alias("bytes"), "sha256")


def attest_files(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, code`` of an inventory with contents against a manifest."""
    return attest_identities(file_identities(inventory), manifest)


def attest_identities(identities: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, code``: missing, unlisted, the first identity that changed, or unread.

    ``git_mode`` is compared where both sides carry it.
    """
    modes = [c for c in ("git_mode",) if c in identities.columns and c in manifest.columns]
    actual = identities.select("path", F.struct("*").alias("a"))
    listed = manifest.select("path", F.struct("byte_length", "line_count", "sha256", "git_blob_sha1", *modes).alias("m"))
    changed = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"m.{f}"))
    code = (
        F.when(F.col("a").isNull(), "file.missing").when(F.col("m").isNull(), "file.unlisted")
        .when(changed("byte_length"), "file.byte_length").when(F.col("a.sha256").isNull(), "file.unread").when(changed("line_count"), "file.line_count")
        .when(changed("sha256"), "file.sha256").when(changed("git_blob_sha1"), "file.git_blob_sha1")
    )
    for mode in modes:
        code = code.when(changed(mode), "file.git_mode")
    return actual.join(listed, "path", "full_outer").select("path", code.alias("code"))


def bind_identity(inventory: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """``path, code`` of one path; one that is on neither side is missing, too."""
    found = attest_files(inventory.where(F.col("path") == path), manifest.where(F.col("path") == path))
    wanted = inventory.sparkSession.range(1).select(F.lit(path).alias("path"))
    return wanted.join(found.select("path", F.struct("code").alias("found")), "path", "left").select(
        "path", F.when(F.col("found").isNull(), "file.missing").otherwise(F.col("found.code")).alias("code"))


def golden_drift(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """``name, code`` for each difference between two ``name, sha256`` tables.

    A row is there or not whatever its hash; a NULL hash equals only a NULL one.
    """
    side = lambda df, name: df.select("name", F.struct("sha256").alias(name))
    joined = side(actual, "a").join(side(expected, "e"), "name", "full_outer")
    code = F.when(F.col("e").isNull(), "golden.extra").when(F.col("a").isNull(), "golden.missing").when(
        ~F.col("a.sha256").eqNullSafe(F.col("e.sha256")), "golden.content")
    return joined.select("name", code.alias("code")).where(F.col("code").isNotNull())


def check_expectations(results: DataFrame, expected: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``key, field, expected, observed`` for every field that differs.

    A result nobody expected, and an expectation without a result, differ in every
    field, NULL ones included.
    """
    side = lambda df, name: df.select(
        key, F.array(*[F.col(f).cast("string") for f in fields]).alias(name))
    both = side(results, "r").join(side(expected, "e"), key, "full_outer")
    pairs = both.select(key, "r", "e", F.posexplode(F.array(*map(F.lit, fields))).alias("i", "field"))
    absent = F.col("r").isNull() | F.col("e").isNull()
    return pairs.select(
        key, "field", F.get("e", F.col("i")).alias("expected"), F.get("r", F.col("i")).alias("observed"), absent.alias("absent"),
    ).where(F.col("absent") | ~F.col("expected").eqNullSafe(F.col("observed"))).drop("absent")
