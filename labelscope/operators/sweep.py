"""Truncation sweeps and grids over boundary cases."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.arrays import int_range, joined, let
from labelscope.functions.bpe import BpeTokenizer
from labelscope.functions.canonical import line_sha256
from labelscope.operators import boundary

DEFAULT_LENGTHS = tuple(range(2, 10))
# --- fixed values: one letter per primary class ------------------------------
CLASS_LETTERS = {
    "aligned": "A", "boundary_drift": "D", "cross_boundary_token": "X",
    "partial_target_truncation": "P", "target_eliminated": "E", "indeterminate": "?",
}
# --- end of fixed values ----------------------------------------------------


def _each(values) -> Column:
    return F.explode(F.array(*map(F.lit, values)))


def truncation_sweep(cases: DataFrame, tokenizer: BpeTokenizer, lengths=DEFAULT_LENGTHS) -> DataFrame:
    """Report of every case at every length.

    Encoding and attribution run once per case, before the rows multiply; each
    length then only slices. What no length changes is written as JSON there, too;
    :func:`sweep_table` finds it in the ``with_written`` of the result.
    """
    attributed = boundary.with_written(boundary.with_tokens(boundary.attributed_cases(cases.drop("max_length"), tokenizer)))
    grid = attributed.withColumn("max_length", _each(lengths))
    wide = boundary.limited_report(grid)
    reports = wide.drop(*boundary.WRITTEN)
    reports.with_written = wide
    return reports


def sweep_table(
    reports: DataFrame, artifact_identity: Mapping | None = None, scope: Mapping | None = None, fixtures: DataFrame | None = None
) -> DataFrame:
    """Flat text form of sweep reports; array fields are ``|``-joined.

    ``stdout_sha256`` hashes the whole canonical report, for which identity and
    scope must be given; it is NULL without them.

    ``fixtures`` (``case_id, base_fixture_path, fixture_raw_sha256``) says where
    cases come from; without it, or for a case it lacks, both are NULL.
    """
    d = lambda name: F.col(f"diagnostics.{name}")
    source = ("base_fixture_path", "fixture_raw_sha256")
    reports = getattr(reports, "with_written", reports)
    written = {name: F.col(c) for c, name in boundary.WRITTEN.items() if c in reports.columns}
    digest = F.lit(None).cast("string") if artifact_identity is None else line_sha256(boundary.report_text(artifact_identity, scope or {}, written))
    # Only the flat rows meet the fixtures: a report is a hundred times as large.
    flat = reports.select(
        "case_id", "max_length",
        F.col("input_identity.canonical_sha256").alias("canonical_input_sha256"),
        boundary.exit_code(F.col("status")).alias("exit_code"),
        digest.alias("stdout_sha256"),
        "status", "primary_classification",
        F.col("legacy_mask.cutoff").alias("legacy_cutoff"),
        d("oracle_cutoff").alias("oracle_cutoff"),
        d("full_target_token_count").alias("full_target_tokens"),
        d("retained_target_token_count").alias("retained_target_tokens"),
        d("supervised_target_token_count").alias("supervised_target_tokens"),
        d("truncated_target_token_count").alias("truncated_target_tokens"),
        joined(d("prompt_leakage_positions")).alias("prompt_leakage_positions"),
        joined(d("cross_boundary_positions")).alias("cross_boundary_positions"),
        joined(d("elimination_causes")).alias("elimination_causes"),
        joined(d("indeterminate_reasons")).alias("indeterminate_reasons"),
    )
    if fixtures is None:
        table = flat.withColumns({name: F.lit(None).cast("string") for name in source})
    else:
        table = flat.join(fixtures.select("case_id", *source), "case_id", "left")
    return table.select("case_id", *source, *[c for c in flat.columns if c != "case_id"])


# --- every length at once -----------------------------------------------------

#: What an interval says at its first length, and by how much that grows a length (0 or 1).
GROWING = ("legacy_cutoff", "retained_target_tokens", "supervised_target_tokens", "leak_stop", "hidden_stop")


def sweep_intervals(cases: DataFrame, tokenizer: BpeTokenizer, lowest: int = S.MIN_MODEL_LENGTH, highest: int = S.MAX_MODEL_LENGTH) -> DataFrame:
    """The sweep over all lengths from ``lowest`` to ``highest``, one row an interval instead of one a length.

    Every field of a report is the same, or one more, at the next length unless the
    length passes a run end, the cutoff, or a token that raises a reason. Between
    two such places one row holds: ``first_length, last_length``, the fields at the
    first, and the steps of those in ``GROWING``. A case has at most nineteen rows.
    Leaks are positions from ``leak_start`` to before ``leak_stop``, hidden targets
    from ``hidden_start`` to before ``hidden_stop``.
    """
    attributed = boundary.attributed_cases(cases.drop("max_length"), tokenizer)
    ends = [F.size("source_raw") + 1, *(F.col(c) for c in ("token_count", "source_end", "cross_end", "target_end")),
            *(F.col(f"source_walk.{f}") for f in ("first_unknown", "first_unaligned", "first_untraced", "first_bad_offset"))]
    # Something may change at a place and again right after it.
    starts = F.array_sort(F.array_distinct(F.filter(
        F.array(F.lit(lowest), *[e + d for e in ends for d in (0, 1)]), lambda x: x.between(lowest, highest))))
    spans = let(starts, lambda b: F.transform(b, lambda x, i: F.struct(
        x.alias("first_length"), (F.coalesce(F.get(b, i + 1), F.lit(highest + 1)) - 1).alias("last_length"))))
    rows = attributed.withColumn("_span", F.explode(spans)).withColumns({
        "first_length": F.col("_span.first_length"), "last_length": F.col("_span.last_length"), "max_length": F.col("_span.first_length")})
    out = boundary.add_classes(boundary.with_limits(rows))
    own, n = F.size("source_raw") + 1, F.col("token_count")
    s, c, t = F.col("source_end"), F.col("cross_end"), F.col("target_end")
    low, high = F.col("first_length"), F.col("last_length")
    within = lambda start, stop: ((low >= start) & (high <= stop) & (low < high)).cast("int")
    mask = F.least(own, n)
    return out.select(
        "case_id", "first_length", "last_length", "status", "primary_classification", "classifications", "elimination_causes", "indeterminate_reasons",
        "oracle_cutoff", F.col("full_target_token_count").alias("full_target_tokens"), "cross_boundary_positions",
        F.col("cutoff").alias("legacy_cutoff"), F.col("retained_target_token_count").alias("retained_target_tokens"),
        F.col("supervised_target_token_count").alias("supervised_target_tokens"),
        F.greatest(F.lit(1), F.col("mask_end")).alias("leak_start"), F.least(s, F.col("kept")).alias("leak_stop"),
        c.alias("hidden_start"), F.least(t, F.col("mask_end")).alias("hidden_stop"),
        within(F.lit(0), own).alias("legacy_cutoff_step"), within(c, F.least(t, n)).alias("retained_target_tokens_step"),
        within(F.greatest(c, mask), F.least(t, n)).alias("supervised_target_tokens_step"),
        within(mask, F.least(s, n)).alias("leak_stop_step"), within(c, F.least(t, mask)).alias("hidden_stop_step"))


def _grown(at: Column) -> dict[str, Column]:
    return {f: F.col(f) + F.col(f"{f}_step") * (at - F.col("first_length")) for f in GROWING}


def at_lengths(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """Reports of ``case_id, max_length`` rows, looked up in the intervals that hold them.

    A case's intervals are few and do not overlap, so the join is on the case and
    the range only picks one of them.
    """
    found = intervals.join(lengths, "case_id").where(F.col("max_length").between(F.col("first_length"), F.col("last_length")))
    return _reported(found)


def expand_intervals(intervals: DataFrame) -> DataFrame:
    """One row a length again."""
    return _reported(intervals.withColumn("max_length", F.explode(F.sequence("first_length", "last_length"))))


def _reported(rows: DataFrame) -> DataFrame:
    grown = rows.withColumns(_grown(F.col("max_length")))
    return grown.select(
        "case_id", "max_length", boundary.exit_code(F.col("status")).alias("exit_code"), "status", "primary_classification",
        "legacy_cutoff", "oracle_cutoff", "full_target_tokens", "retained_target_tokens", "supervised_target_tokens",
        (F.col("full_target_tokens") - F.col("retained_target_tokens")).alias("truncated_target_tokens"),
        joined(int_range(F.col("leak_start"), F.col("leak_stop"))).alias("prompt_leakage_positions"),
        joined(F.col("cross_boundary_positions")).alias("cross_boundary_positions"),
        joined(F.col("elimination_causes")).alias("elimination_causes"), joined(F.col("indeterminate_reasons")).alias("indeterminate_reasons"),
        joined(int_range(F.col("hidden_start"), F.col("hidden_stop"))).alias("masked_retained_target_positions"))


def class_letter(primary: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in CLASS_LETTERS.items() for x in item])
    return F.coalesce(F.try_element_at(table, primary), F.lit("?"))


def retention_matrix(reports: DataFrame, lengths=DEFAULT_LENGTHS) -> DataFrame:
    """Case by length: class letter and ``retained/full`` target tokens."""
    cell = F.concat(
        class_letter(F.col("primary_classification")), F.lit(" "),
        F.col("diagnostics.retained_target_token_count").cast("string"), F.lit("/"),
        F.col("diagnostics.full_target_token_count").cast("string"))
    return reports.select("case_id", "max_length", cell.alias("cell")).groupBy("case_id").pivot(
        "max_length", list(lengths)).agg(F.first("cell"))


def input_matrix(sources: DataFrame, targets) -> DataFrame:
    """``case_id, source`` rows against each listed target.

    Targets are parameters, so rows grow linearly with ``sources``.
    """
    return sources.withColumn("target", _each(targets))


def input_matrix_counts(cases: DataFrame, tokenizer: BpeTokenizer, lengths) -> DataFrame:
    """Number of (case, length) cells per combination of classifications."""
    reports = truncation_sweep(cases, tokenizer, lengths)
    return reports.groupBy(F.array_join("classifications", "|").alias("classifications")).agg(
        F.count(F.lit(1)).alias("cases"))
