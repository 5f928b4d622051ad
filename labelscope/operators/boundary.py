"""Source/target boundary audit: where a length-based mask and token ownership part.

Input rows are ``case_id, source, target, max_length``. Everything is row-local:
one scan, one projection chain, no exchange.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions import bpe
from labelscope.functions import unicode as uni
from labelscope.functions.arrays import (
    compact_codes,
    empty,
    first_index,
    int_range,
    let,
    positions_where,
)
from labelscope.functions.bpe import BpeTokenizer
from labelscope.functions.canonical import NULLS, canonical_json, json_object, line_sha256
from labelscope.operators.contract import validate_cases

ENCODINGS = ("source_truncated", "combined_full", "combined_truncated")


# --- normalization and encoding ---------------------------------------------


def concat_pair(cases: DataFrame) -> DataFrame:
    """Adds ``combined`` and ``boundary`` (the source's code-point length)."""
    return cases.withColumns({
        "combined": F.concat("source", "target"),
        "boundary": F.char_length("source"),
    })


def normalize_cases(cases: DataFrame) -> DataFrame:
    """Adds the ``source_*`` and ``combined_*`` normalization columns."""
    return uni.with_normalization(concat_pair(cases), ("source", "combined"))


def cross_boundary_output_positions(starts: Column, ends: Column, count: Column, boundary: Column) -> Column:
    """Normalized positions whose raw origins lie on both sides of ``boundary``."""
    spans = F.slice(F.arrays_zip(starts.alias("s"), ends.alias("e")), F.lit(1), count)
    crossing = let(boundary, lambda b: positions_where(spans, lambda o, i: (o["s"] < b) & (b < o["e"])))
    # Identity provenance gives every position a single origin.
    return F.when(starts.isNull(), empty("int")).otherwise(crossing)


def normalization_snapshot(name: str) -> Column:
    c = lambda field: F.col(f"{name}_{field}")
    cross = cross_boundary_output_positions(c("starts"), c("ends"), F.char_length(c("normalized")), F.col("boundary"))
    return F.struct(
        F.when(runtime_matches(name), cross).otherwise(empty("int")).alias("cross_boundary_output_positions"),
        c("nfc_count").alias("nfc_codepoint_count"),
        F.char_length(c("normalized")).alias("normalized_codepoint_count"),
        (c("complete") & runtime_matches(name)).alias("provenance_complete"),
        c("raw_count").alias("raw_codepoint_count"),
        (c("nfc_count") - F.char_length(c("normalized"))).alias("trailing_normalized_codepoints_removed"),
    )


def encode_cases(normalized: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    """Adds pieces and the untruncated encodings ``source_full`` and ``combined_full``."""
    pieces = bpe.with_pieces(normalized, tokenizer, ("source", "combined"))
    return bpe.with_vectors(pieces, tokenizer, {n: f"{n}_full" for n in ("source", "combined")})


def truncate_encodings(encoded: DataFrame) -> DataFrame:
    """Adds ``source_truncated`` and ``combined_truncated`` (BOS counts)."""
    names = {"source_full": "source_truncated", "combined_full": "combined_truncated"}
    return bpe.with_truncations(encoded, names, F.col("max_length"))


def three_encodings(cases: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    return truncate_encodings(encode_cases(normalize_cases(cases), tokenizer))


# --- attribution ------------------------------------------------------------


def ownership(start: Column, end: Column, boundary: Column) -> Column:
    """Owner of the raw interval ``[start, end)``."""
    return (
        F.when((start < boundary) & (end > boundary), "cross_boundary")
        .when(end <= boundary, "source")
        .otherwise("target")
    )


def _first_misaligned(pieces: Column, normalized: Column) -> Column:
    """Index of the first piece that leaves ``normalized``, character by character."""
    wanted = F.regexp_extract_all(normalized, F.lit("(?s)."), F.lit(0))
    chars = F.regexp_extract_all(F.array_join(pieces, ""), F.lit("(?s)."), F.lit(0))
    owner = F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(i, F.char_length(p))))
    # zip_with pads with NULL; only positions a piece covers can differ.
    differs = F.zip_with(chars, wanted, lambda c, w: c.isNotNull() & ~c.eqNullSafe(w))
    return let(owner, lambda o: F.get(o, F.array_position(differs, True).cast("int") - 1))


def _walk(encoding: str, text: str, matches: Column, tokenizer: BpeTokenizer) -> Column:
    """Follow the body pieces of an encoding along the normalized text.

    The struct holds the token index at which each reason first applies, so the
    reasons of any truncation are scalar comparisons, and the raw span of every
    piece that stays aligned.
    """
    body = lambda v: F.slice(f"{encoding}__{v}", F.lit(2), F.size(f"{encoding}__{v}"))
    normalized = F.col(f"{text}_normalized")
    usable = F.col(f"{text}_complete") & matches
    unknown = F.zip_with(
        body("ids"), body("pieces"), lambda i, t: (i == tokenizer.unknown_id) | (t == tokenizer.unknown_piece))

    def after_unknown(u: Column) -> Column:
        first = F.nullif(F.array_position(u, True).cast("int"), F.lit(0))
        known = F.slice(body("pieces"), F.lit(1), F.coalesce(first - 1, F.size(u)))
        return let(F.struct(first.alias("unknown"), known.alias("known")), lambda k: after_known(u, k))

    def after_known(u: Column, k: Column) -> Column:
        misaligned = F.when(
            ~F.startswith(normalized, F.array_join(k["known"], "")), _first_misaligned(k["known"], normalized))
        return let(F.least(misaligned, k["unknown"] - 1, F.size(u)), lambda bad: after_aligned(u, k, bad))

    def after_aligned(u: Column, k: Column, bad: Column) -> Column:
        aligned = F.slice(k["known"], F.lit(1), bad)
        return let(
            F.struct(
                k["unknown"].alias("first_unknown"),
                (first_index(u, lambda x, i: (i >= bad) & ~x) + 1).alias("first_unaligned"),
                F.when(~usable & (bad > 0), F.lit(1)).alias("first_untraced"),
                (F.char_length(F.array_join(aligned, "")) == F.char_length(normalized)).alias("consumed"),
                F.when(usable, _raw_spans(aligned, text)).otherwise(F.array().cast(_SPANS)).alias("raw"),
            ),
            after_spans,
        )

    def after_spans(w: Column) -> Column:
        fits = let(
            F.col(f"{text}_raw_count"),
            lambda count: F.zip_with(
                w["raw"],
                F.slice(body("offsets"), F.lit(1), F.size(w["raw"])),
                lambda r, o: (o["start"] < o["end"]) & (o["end"] <= count)
                & (r["start"] <= o["start"]) & (o["end"] <= r["end"]),
            ),
        )
        bad_offset = F.nullif(F.array_position(fits, False).cast("int"), F.lit(0))
        return F.struct(
            w["first_unknown"], w["first_unaligned"], w["first_untraced"],
            bad_offset.alias("first_bad_offset"), w["consumed"], w["raw"], fits.alias("fits"),
        )

    return let(unknown, after_unknown)


_SPANS = "array<struct<start:int,end:int>>"


def _raw_spans(pieces: Column, text: str) -> Column:
    """Raw interval each aligned piece came from."""
    origins = F.struct(F.col(f"{text}_starts").alias("s"), F.col(f"{text}_ends").alias("e"))
    return let(
        origins,
        lambda o: F.transform(
            bpe.char_spans(pieces),
            lambda c: F.when(o["s"].isNull(), c).otherwise(
                F.struct(F.get(o["s"], c["start"]).alias("start"), F.get(o["e"], c["end"] - 1).alias("end"))),
        ),
    )


def _tokens(encoding: str, walk: str) -> Column:
    """Ownership and raw origins of every position, prefix token included."""
    nothing = empty("int")
    known = let(
        F.col("boundary"),
        lambda b: F.transform(
            F.arrays_zip(F.col(f"{walk}.raw").alias("r"), F.col(f"{walk}.fits").alias("ok")),
            lambda z, i: F.struct(
                F.when(z["ok"], ownership(z["r"]["start"], z["r"]["end"], b)).otherwise("ambiguous").alias("ownership"),
                (i + 1).alias("position"),
                F.sequence(z["r"]["start"], z["r"]["end"] - 1).alias("raw_origins"),
            ),
        ),
    )
    rest = F.transform(
        int_range(F.size(f"{walk}.raw") + 1, F.size(f"{encoding}__ids")),
        lambda i: F.struct(F.lit("ambiguous").alias("ownership"), i.alias("position"), nothing.alias("raw_origins")),
    )
    head = F.struct(F.lit("injected_prefix").alias("ownership"), F.lit(0).alias("position"), nothing.alias("raw_origins"))
    return F.concat(F.array(head), known, rest)


def runtime_matches(text: str) -> Column:
    """The encoder's normalized text equals the replay's."""
    return F.col(f"{text}_encoder_text") == F.col(f"{text}_normalized")


def attribute_tokens(df: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    """Adds ``source_walk``, ``full_walk`` and ``full_tokens`` for supplied encodings."""
    out = df.withColumns({
        "source_walk": _walk("source_truncated", "source", runtime_matches("source"), tokenizer),
        "full_walk": _walk("combined_full", "combined", runtime_matches("combined"), tokenizer),
    })
    return out.withColumn("full_tokens", _tokens("combined_full", "full_walk"))


def _own_walk(text: str, tokenizer: BpeTokenizer) -> Column:
    """As :func:`_walk`, for pieces made here: they spell the encoder's text and
    their offsets follow from the provenance, so there is little to check."""
    raw, ids = F.col(f"{text}_raw"), F.col(f"{text}_ids")
    usable = F.col(f"{text}_complete") & runtime_matches(text)
    first_unknown = F.nullif(
        F.array_position(ids, F.lit(tokenizer.unknown_id).cast("bigint")).cast("int"), F.lit(0))
    misaligned = F.when(~runtime_matches(text), _first_misaligned(raw, F.col(f"{text}_normalized")))

    def flags(x: Column) -> Column:
        bad = F.least(x["unknown"] - 1, x["misaligned"], F.size(raw))
        unaligned = F.when(bad < F.size(raw), first_index(
            ids, lambda t, i: (i >= bad) & (t != tokenizer.unknown_id)) + 1)
        aligned = F.array_join(F.slice(raw, F.lit(1), bad), "")
        return F.struct(
            x["unknown"].alias("first_unknown"), unaligned.alias("first_unaligned"),
            F.when(~usable & (bad > 0), F.lit(1)).alias("first_untraced"),
            F.lit(None).cast("int").alias("first_bad_offset"),
            F.when(bad == F.size(raw), runtime_matches(text) | (F.char_length(aligned) == F.char_length(f"{text}_normalized")))
            .otherwise(F.char_length(aligned) == F.char_length(f"{text}_normalized")).alias("consumed"),
            F.when(usable, bad).otherwise(0).alias("traced"),
        )

    return let(F.struct(first_unknown.alias("unknown"), misaligned.alias("misaligned")), flags)


def _cuts(spans: Column, low: Column, high: Column) -> Column:
    """How many of the ascending spans end by ``low``, and how many begin before ``high``."""
    return F.struct(
        F.size(F.filter(spans["end"], lambda e: e <= low)).alias("ends"),
        F.size(F.filter(spans["start"], lambda s: s < high)).alias("begins"))


def attributed_cases(cases: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    """Full encodings and attribution, before any length limit is applied.

    Tokens follow the text, so ownership is a run of source tokens, those across
    the boundary, the target's, then whatever could not be traced. The run ends
    ``source_end``, ``cross_end`` and ``target_end`` say it all; position lists
    and counts of any truncation are arithmetic on them.
    """
    out = encode_cases(normalize_cases(cases), tokenizer)
    out = out.withColumns({
        "source_walk": _own_walk("source", tokenizer), "full_walk": _own_walk("combined", tokenizer)})
    b = F.col("boundary")
    count = lambda column, test: let(b, lambda at: F.size(F.filter(column, lambda v: test(v, at))))
    # Normalized positions wholly before, and beginning before, the boundary.
    low = F.when(F.col("combined_starts").isNull(), b).otherwise(count("combined_ends", lambda v, at: v <= at))
    high = F.when(F.col("combined_starts").isNull(), b).otherwise(count("combined_starts", lambda v, at: v < at))
    traced = F.slice("combined_spans", F.lit(1), F.col("full_walk.traced"))
    cuts = let(F.struct(traced.alias("spans"), low.alias("low"), high.alias("high")), lambda x: _cuts(x["spans"], x["low"], x["high"]))
    out = out.withColumn("_cuts", cuts)
    return out.withColumns({
        "source_end": F.col("_cuts.ends") + 1,
        "cross_end": F.col("_cuts.begins") + 1,
        "target_end": F.col("full_walk.traced") + 1,
        "token_count": F.size("combined_raw") + 1,
    }).drop("_cuts")


def _own_tokens() -> Column:
    """Per-position attribution of an encoding made here."""
    nothing = empty("int")
    s, c, t, n = F.col("source_end"), F.col("cross_end"), F.col("target_end"), F.col("token_count")
    owners = F.concat(
        F.array(F.lit("injected_prefix")), F.array_repeat(F.lit("source"), s - 1), F.array_repeat(F.lit("cross_boundary"), c - s),
        F.array_repeat(F.lit("target"), t - c), F.array_repeat(F.lit("ambiguous"), n - t))
    traced = F.slice("combined_spans", F.lit(1), t - 1)
    covered = lambda start, end: F.when(end == start + 1, F.array(start)).otherwise(F.sequence(start, end - 1))
    moved = let(F.struct(F.col("combined_starts").alias("starts"), F.col("combined_ends").alias("ends")), lambda x: F.transform(
        traced, lambda span: covered(F.get(x["starts"], span["start"]), F.get(x["ends"], span["end"] - 1))))
    origins = F.when(F.col("combined_starts").isNull(), F.transform(traced, lambda span: covered(span["start"], span["end"]))).otherwise(moved)
    return F.arrays_zip(
        owners.alias("ownership"), int_range(0, n).alias("position"),
        F.concat(F.array(nothing), origins, F.array_repeat(nothing, n - t)).alias("raw_origins"))


def attribution_reasons(walk: str, text: str, kept: Column, must_consume: Column) -> Column:
    """Reasons raised by the first ``kept`` tokens of an attributed encoding."""
    w = lambda field: F.col(f"{walk}.{field}")
    return F.concat(
        F.col(f"{text}_norm_reasons"),
        compact_codes(
            (~runtime_matches(text), "normalization.runtime_mismatch"),
            (w("first_unknown") < kept, "encoding.unknown_token"),
            ((w("first_unaligned") < kept) | (must_consume & ~w("consumed")), "encoding.piece_alignment"),
            (w("first_untraced") < kept, "normalization.provenance_ambiguous"),
            (w("first_bad_offset") < kept, "encoding.offset_provenance"),
        ),
    )


def unproven_attribution(encoding: str, tokenizer: BpeTokenizer) -> Column:
    """Ownership when a truncated encoding is not a prefix of the full one."""
    zipped = F.arrays_zip(
        F.col(f"{encoding}__ids").alias("id"), F.col(f"{encoding}__pieces").alias("piece"),
        F.col(f"{encoding}__offsets").alias("offset"), F.col(f"{encoding}__special_tokens_mask").alias("special"),
    )
    is_prefix_token = lambda z, i: (
        (i == 0) & (z["id"] == tokenizer.bos_id) & (z["piece"] == tokenizer.bos_piece)
        & (z["offset"]["start"] == 0) & (z["offset"]["end"] == 0) & (z["special"] == 1)
    )
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            F.when(is_prefix_token(z, i), "injected_prefix").otherwise("ambiguous").alias("ownership"),
            i.alias("position"),
            empty("int").alias("raw_origins"),
        ),
    )


# --- diagnostics ------------------------------------------------------------


def _owned(owners: str, owner: str, extra=None) -> Column:
    test = (lambda o, i: (o == owner) & extra(i)) if extra else (lambda o, i: o == owner)
    return positions_where(F.col(owners), test)


def add_positions(df: DataFrame) -> DataFrame:
    """Positions, oracle cutoff and target counts from per-position owners.

    Needs ``full_owners``, ``kept_owners``, ``cutoff``, ``kept`` and ``mask_end``.
    """
    first_target = F.array_position(F.col("kept_owners"), "target").cast("int") - 1
    first_ambiguous = F.array_position(F.col("kept_owners"), "ambiguous").cast("int") - 1
    out = df.withColumns({
        "prompt_leakage_positions": let(
            F.col("mask_end"), lambda m: _owned("kept_owners", "source", lambda i: i >= m)),
        "masked_retained_target_positions": let(
            F.col("mask_end"), lambda m: _owned("kept_owners", "target", lambda i: i < m)),
        "cross_boundary_positions": _owned("full_owners", "cross_boundary"),
        "ambiguous_positions": _owned("full_owners", "ambiguous"),
        "oracle_cutoff": F.when(
            (first_target >= 0) & ~((first_ambiguous >= 0) & (first_ambiguous < first_target)), first_target),
        "full_target_token_count": F.size(_owned("full_owners", "target")),
        "retained_target_token_count": F.size(_owned("kept_owners", "target")),
        "_supervised_ambiguous": F.array_contains(
            F.slice(F.col("kept_owners"), F.col("mask_end") + 1, F.col("kept")), "ambiguous"),
    })
    return out.withColumn(
        "supervised_target_token_count",
        F.col("retained_target_token_count") - F.size("masked_retained_target_positions"))


def add_classes(df: DataFrame) -> DataFrame:
    """Reasons, causes, classifications and status from positions and counts."""
    full, retained = F.col("full_target_token_count"), F.col("retained_target_token_count")
    absent = (full == 0) & (F.size("cross_boundary_positions") == 0) & (F.size("ambiguous_positions") == 0)
    out = df.withColumns({
        "truncated_target_token_count": full - retained,
        "indeterminate_reasons": F.array_sort(F.array_distinct(F.concat(
            F.col("base_reasons"),
            compact_codes(
                (~F.col("exact_prefix"), "truncation.not_exact_prefix"),
                (absent, "target.no_attributable_token"),
            ),
        ))),
        "target_eliminated": F.col("exact_prefix") & (full > 0)
        & (F.col("supervised_target_token_count") == 0) & ~F.col("_supervised_ambiguous"),
        "partial_target_truncation": F.col("exact_prefix") & (retained > 0) & (retained < full),
        "boundary_drift": (F.size("prompt_leakage_positions") > 0)
        | (F.size("masked_retained_target_positions") > 0)
        | F.coalesce(F.col("oracle_cutoff") != F.col("cutoff"), F.lit(False)),
    })
    out = out.withColumns({
        "elimination_causes": F.when(
            F.col("target_eliminated"),
            compact_codes((retained < full, "truncation"), (retained > 0, "legacy_cutoff")),
        ).otherwise(empty("string")),
        "classifications": classifications(),
    })
    return add_status(out).drop("_supervised_ambiguous")


def classifications() -> Column:
    """Every observed class in precedence order; ``aligned`` only alone."""
    observed = compact_codes(
        ((F.size("indeterminate_reasons") > 0) | (F.size("ambiguous_positions") > 0), "indeterminate"),
        (F.size("cross_boundary_positions") > 0, "cross_boundary_token"),
        (F.col("target_eliminated"), "target_eliminated"),
        (F.col("partial_target_truncation"), "partial_target_truncation"),
        (F.col("boundary_drift"), "boundary_drift"),
    )
    return let(observed, lambda c: F.when(F.size(c) == 0, F.array(F.lit("aligned"))).otherwise(c))


def add_status(df: DataFrame) -> DataFrame:
    primary = F.get("classifications", F.lit(0))
    return df.withColumns({
        "primary_classification": primary,
        "status": F.when(primary == "indeterminate", "indeterminate")
        .when(primary == "aligned", "pass").otherwise("fail"),
    })


def exit_code(status: Column, rejected: Column | None = None) -> Column:
    """0 pass, 1 fail or indeterminate, 2 rejected."""
    code = F.when(status == "pass", 0).otherwise(1)
    return code if rejected is None else F.when(rejected, 2).otherwise(code)


# --- whole reports ----------------------------------------------------------


def boundary_report(cases: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    """One flat report row per case that meets the contract; raw text stays out.

    Other cases get no report: ``contract.validate_cases`` names their code.
    """
    valid = validate_cases(cases).where(F.col("error_code").isNull()).drop("error_code")
    return limited_report(attributed_cases(valid, tokenizer))


def limited_report(attributed: DataFrame) -> DataFrame:
    """Apply ``max_length`` to attributed rows and report.

    The truncated encoding is a slice of the full one, so it is always an exact
    prefix and every diagnostic is arithmetic on the run ends.
    """
    out = attributed if "full_tokens" in attributed.columns else with_tokens(attributed)
    out = with_limits(truncate_encodings(out))
    out = out.withColumn("kept_tokens", F.slice("full_tokens", F.lit(1), F.col("kept")))
    return _report_columns(add_classes(out))


def with_tokens(attributed: DataFrame) -> DataFrame:
    """Adds ``full_tokens``, which no length changes."""
    return attributed.withColumn("full_tokens", _own_tokens())


#: Canonical JSON of what no length changes, by the column that holds it and the report's column.
WRITTEN = {"_full_attribution_text": "full_attribution", "_combined_full_text": "combined_full"}


def with_written(attributed: DataFrame) -> DataFrame:
    """Adds the columns ``WRITTEN`` to rows with ``full_tokens``."""
    found = attributed.withColumn("combined_full", bpe.as_struct("combined_full"))
    return found.withColumns({
        "_full_attribution_text": _attribution_text("full_tokens"), "_combined_full_text": _encoding_text("combined_full")}).drop("combined_full")


def with_limits(attributed: DataFrame, source_tokens: Column | None = None) -> DataFrame:
    """Cutoffs, positions, counts and reasons at ``max_length``, from the run ends alone.

    ``source_tokens`` is the source's own number of tokens, prefix token included.
    """
    limit = F.col("max_length")
    cutoff = F.least(F.size("source_raw") + 1 if source_tokens is None else source_tokens, limit)
    kept = F.least(F.col("token_count"), limit)
    out = attributed.withColumns({"cutoff": cutoff, "kept": kept, "mask_end": F.least(cutoff, kept), "exact_prefix": F.lit(True)})
    m, k = F.col("mask_end"), F.col("kept")
    s, c, t, n = F.col("source_end"), F.col("cross_end"), F.col("target_end"), F.col("token_count")
    zero = F.lit(0)
    return out.withColumns({
        "prompt_leakage_positions": int_range(F.greatest(F.lit(1), m), F.least(s, k)),
        "masked_retained_target_positions": int_range(c, F.least(t, m)),
        "cross_boundary_positions": int_range(s, c),
        "ambiguous_positions": int_range(t, n),
        "oracle_cutoff": F.when(c < F.least(t, k), c),
        "full_target_token_count": t - c,
        "retained_target_token_count": F.greatest(zero, F.least(t, k) - c),
        "supervised_target_token_count": F.greatest(zero, F.least(t, k) - F.greatest(c, m)),
        "_supervised_ambiguous": F.greatest(t, m) < k,
        "base_reasons": F.concat(
            attribution_reasons("source_walk", "source", cutoff, cutoff < limit),
            attribution_reasons("full_walk", "combined", n, F.lit(True))),
    })


def report_from_encodings(df: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    """Audit the three encodings that came with the rows.

    Rows hold the case, the ``source_*``/``combined_*`` normalization columns and
    one struct column per encoding (``schemas.ENCODING``). Nothing about them is
    taken for granted: pieces are followed along the text, offsets are checked
    against provenance and the truncation against the full encoding.
    """
    out = df
    for name in ENCODINGS:
        out = bpe.from_struct(out, name)
    out = attribute_tokens(out, tokenizer)
    kept, cutoff = F.size("combined_truncated__ids"), F.size("source_truncated__ids")
    out = out.withColumns({
        "cutoff": cutoff,
        "kept": kept,
        "mask_end": F.least(cutoff, kept),
        "exact_prefix": bpe.exact_prefix("combined_full", "combined_truncated"),
        "base_reasons": F.concat(
            attribution_reasons("source_walk", "source", cutoff, cutoff < F.col("max_length")),
            attribution_reasons("full_walk", "combined", F.size("combined_full__ids"), F.lit(True)),
        ),
    })
    out = out.withColumn(
        "kept_tokens",
        F.when(F.col("exact_prefix"), F.slice("full_tokens", F.lit(1), kept)).otherwise(
            unproven_attribution("combined_truncated", tokenizer)),
    )
    out = out.withColumns({
        "full_owners": F.transform("full_tokens", lambda t: t["ownership"]),
        "kept_owners": F.transform("kept_tokens", lambda t: t["ownership"]),
    })
    return _report_columns(add_classes(add_positions(out)))


def _report_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "case_id", "max_length", "status", "primary_classification", "classifications",
        F.struct(
            F.col("boundary").alias("boundary_codepoint"),
            case_sha256(F.col("case_id"), F.col("max_length"), F.col("source"), F.col("target")).alias("canonical_sha256"),
            "case_id", "max_length",
            F.col("boundary").alias("source_codepoints"),
            F.char_length("target").alias("target_codepoints"),
        ).alias("input_identity"),
        normalization_snapshot("source").alias("source_normalization"),
        normalization_snapshot("combined").alias("combined_normalization"),
        *[bpe.as_struct(name) for name in ENCODINGS],
        F.struct(
            F.lit(S.MASK_ALGORITHM).alias("algorithm"),
            "cutoff",
            int_range(0, F.col("mask_end")).alias("masked_positions"),
            int_range(F.col("mask_end"), F.col("kept")).alias("supervised_positions"),
        ).alias("legacy_mask"),
        F.col("full_tokens").alias("full_attribution"),
        F.col("kept_tokens").alias("truncated_attribution"),
        F.struct(
            "ambiguous_positions", "cross_boundary_positions", "elimination_causes",
            "full_target_token_count", "indeterminate_reasons", "masked_retained_target_positions",
            "oracle_cutoff", "prompt_leakage_positions", "retained_target_token_count",
            "supervised_target_token_count", "truncated_target_token_count",
        ).alias("diagnostics"),
        *[c for c in WRITTEN if c in out.columns],
    )


def input_identity(cases: DataFrame) -> DataFrame:
    """Counts and content hash of each case, without its text."""
    return cases.select(
        "case_id",
        case_sha256(F.col("case_id"), F.col("max_length"), F.col("source"), F.col("target")).alias("canonical_sha256"),
        F.char_length("source").alias("source_codepoints"),
        F.char_length("target").alias("target_codepoints"),
        F.char_length("source").alias("boundary_codepoint"),
        "max_length",
    )


def case_sha256(case_id: Column, max_length: Column, source: Column, target: Column) -> Column:
    document = F.struct(
        case_id.alias("case_id"),
        max_length.alias("max_length"),
        F.lit(S.CASE_SCHEMA_VERSION).alias("schema_version"),
        source.alias("source"),
        target.alias("target"),
    )
    return line_sha256(canonical_json(document, ascii_only=True))


def _literal(value) -> Column:
    if isinstance(value, Mapping):
        return F.struct(*[_literal(value[k]).alias(k) for k in sorted(value)])
    if isinstance(value, Sequence) and not isinstance(value, str):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def _encoding_text(name: str) -> Column:
    """Canonical JSON of an encoding; its pieces are the only member with characters to escape."""
    part = lambda v: F.col(f"{name}.{v}")
    members = {v: canonical_json(part(v), ascii_only=True) if v == "pieces" else F.to_json(part(v), NULLS) for v in bpe.VECTORS}
    return F.when(F.col(name).isNotNull(), json_object(members))


def _attribution_text(name: str) -> Column:
    """Canonical JSON of an attribution, in which only an unknown owner can have characters to escape."""
    odd = F.exists(name, lambda t: ~t["ownership"].isin(*S.OWNERSHIPS))
    return F.when(F.coalesce(odd, F.lit(False)), canonical_json(F.col(name), ascii_only=True)).otherwise(F.to_json(name, NULLS))


def report_text(artifact_identity: Mapping, scope: Mapping, written: Mapping[str, Column] | None = None) -> Column:
    """Canonical ASCII JSON of a report row; identity and scope are the caller's.

    ``written`` has the JSON of columns for which it is at hand.

    Report structs already declare their fields alphabetically. The long members are
    written on their own, so that few characters are looked at for escapes.
    """
    quoted = lambda column: let(canonical_json(F.array(column), ascii_only=True), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    written = written or {}
    at_hand = lambda name, text: written[name] if name in written else text(name)
    return json_object({
        "artifact_identity": canonical_json(_literal(artifact_identity), ascii_only=True),
        "attribution": json_object({part: at_hand(f"{part}_attribution", _attribution_text) for part in ("full", "truncated")}),
        "classifications": canonical_json(F.col("classifications"), ascii_only=True),
        "diagnostics": canonical_json(F.col("diagnostics"), ascii_only=True),
        "encodings": json_object({name: at_hand(name, _encoding_text) for name in ENCODINGS}),
        "input_identity": canonical_json(F.col("input_identity"), ascii_only=True),
        "kind": F.lit('"token-boundary.differential-report"'),
        "legacy_mask": canonical_json(F.col("legacy_mask"), ascii_only=True),
        "normalization": json_object({side: F.to_json(F.col(f"{side}_normalization"), NULLS) for side in ("combined", "source")}),
        "primary_classification": quoted("primary_classification"),
        "schema_version": F.lit('"token-boundary-differential-report-v1"'),
        "scope": canonical_json(_literal(scope), ascii_only=True),
        "status": quoted("status"),
    })


def report_json(reports: DataFrame, artifact_identity: Mapping, scope: Mapping) -> DataFrame:
    """Canonical JSON of each report and its hash."""
    text = reports.select("case_id", "status", report_text(artifact_identity, scope).alias("report"))
    return text.withColumn("report_sha256", line_sha256(F.col("report")))
