"""Label topology of pretokenized traces, one row per example, no exchange.

``traces`` rows are ``example_id, messages, trace`` (``schemas.TRACES``).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.arrays import compact_codes, empty, int_range, let, positions_where
from labelscope.functions.canonical import canonical_json, labels_sha256, line_sha256



def padding_start(trace: Column) -> Column:
    return F.get(trace["segments"], F.size(trace["segments"]) - 1)["start"]


def token_categories(trace: Column, messages: Column) -> Column:
    """``padding``, ``boundary`` or the message role, for every position."""
    return let(messages, lambda m: F.flatten(F.transform(
        trace["segments"],
        lambda s: F.array_repeat(
            F.when(s["kind"] == "padding", "padding")
            .when(s["kind"].isin(*S.BOUNDARY_KINDS), "boundary")
            .otherwise(F.get(m, s["message_index"])["role"]),
            s["end"] - s["start"],
        ),
    )))


def positions_for_kinds(trace: Column, kinds: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(
        F.filter(trace["segments"], lambda s: s["kind"].isin(*kinds)),
        lambda s: int_range(s["start"], s["end"]),
    ))


def require_policy(policy: str) -> str:
    if policy not in S.POLICIES:
        raise ValueError("policy.unsupported")
    return policy


def policy_code(policy: Column) -> Column:
    return F.when(~F.coalesce(policy.isin(*S.POLICIES), F.lit(False)), "policy.unsupported")


def eligible_mask(categories: Column, policy: Column) -> Column:
    """Whether ``policy`` supervises each position."""
    return let(policy, lambda p: F.transform(
        categories, lambda c: F.when(p == S.ALL_TOKENS, c != "padding").otherwise(c == "assistant")))


def eligible_positions(trace: Column, messages: Column, policy: str) -> Column:
    mask = eligible_mask(token_categories(trace, messages), F.lit(require_policy(policy)))
    return positions_where(mask, lambda ok, i: ok)


def build_labels(trace: Column, messages: Column, policy) -> Column:
    """Token id where the policy supervises, the ignore index elsewhere."""
    policy = F.lit(require_policy(policy)) if isinstance(policy, str) else policy
    mask = eligible_mask(token_categories(trace, messages), policy)
    return F.zip_with(trace["token_ids"], mask, lambda t, ok: F.when(ok, t).otherwise(S.IGNORE_INDEX))


def label_code(token_ids: Column, labels: Column) -> Column:
    """Length first, then the earliest position with a bad label."""
    pairs = F.zip_with(
        labels, token_ids,
        lambda l, t: F.when(l.isNull(), "labels.type").when((l != S.IGNORE_INDEX) & (l != t), "labels.token_mismatch"))
    return F.when(F.size(labels) != F.size(token_ids), "labels.length").otherwise(
        F.get(F.filter(pairs, lambda c: c.isNotNull()), F.lit(0)))


def supervised_positions(labels: Column) -> Column:
    return positions_where(labels, lambda l, i: l != S.IGNORE_INDEX)


def supervised_runs(labels: Column) -> Column:
    """Maximal half-open runs of supervised positions."""
    def edges(l: Column) -> Column:
        on = lambda i: F.coalesce(F.get(l, i) != S.IGNORE_INDEX, F.lit(False))
        starts = positions_where(l, lambda x, i: (x != S.IGNORE_INDEX) & ~F.when(i > 0, on(i - 1)).otherwise(False))
        ends = positions_where(l, lambda x, i: (x != S.IGNORE_INDEX) & ~on(i + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(
            (e + 1).alias("end"), (e + 1 - s).alias("length"), s.alias("start")))

    return let(labels, edges)


def trace_summary(traces: DataFrame) -> DataFrame:
    """Adds the five counts of a trace."""
    return traces.withColumns({
        "message_count": F.size("messages"),
        "assistant_message_count": F.size(F.filter("messages", lambda m: m["role"] == "assistant")),
        "token_count": F.size("trace.token_ids"),
        "non_padding_token_count": padding_start(F.col("trace")),
        "padding_token_count": F.size("trace.token_ids") - padding_start(F.col("trace")),
    })


def empty_assistant_indices(trace: Column, messages: Column) -> Column:
    """Assistant messages whose content span holds no token."""
    return let(messages, lambda m: F.transform(
        F.filter(trace["segments"], lambda s: (s["kind"] == "message_content") & (s["end"] == s["start"])
                 & (F.get(m, s["message_index"])["role"] == "assistant")),
        lambda s: s["message_index"],
    ))


def policy_audits(rows: DataFrame) -> DataFrame:
    """Audit ``labels`` against ``policy``; rows carry both with their trace.

    Adds the counts, position lists, runs and digest of one policy audit.
    ``error_code`` is set, and nothing else, where the labels are unusable.
    """
    out = rows.withColumns({
        "error_code": F.coalesce(policy_code(F.col("policy")), label_code(F.col("trace.token_ids"), F.col("labels"))),
        "_categories": token_categories(F.col("trace"), F.col("messages")),
    })
    # One pass joins label, category and eligibility per position.
    cells = F.zip_with(
        F.when(F.col("error_code").isNull(), F.col("labels")),
        F.arrays_zip(
            F.col("_categories").alias("c"), eligible_mask(F.col("_categories"), F.col("policy")).alias("e")),
        lambda l, z: F.struct((l != S.IGNORE_INDEX).alias("on"), z["c"].alias("c"), z["e"].alias("e")),
    )
    out = out.withColumn("_cells", cells)
    at = lambda test: positions_where(F.col("_cells"), lambda z, i: test(z))
    count = lambda test: F.size(F.filter("_cells", test))
    return out.withColumns({
        "labels_sha256": F.when(F.col("error_code").isNull(), labels_sha256(F.col("labels"))),
        "eligible_token_count": count(lambda z: z["e"]),
        "supervised_token_count": count(lambda z: z["on"]),
        "ignored_token_count": count(lambda z: ~z["on"]),
        "boundary_supervised_token_count": count(lambda z: z["on"] & (z["c"] == "boundary")),
        "supervised_runs": F.when(F.col("error_code").isNull(), supervised_runs(F.col("labels"))),
        "boundary_leakage_positions": at(lambda z: z["on"] & ~z["e"] & (z["c"] == "boundary")),
        "padding_leakage_positions": at(lambda z: z["on"] & (z["c"] == "padding")),
        "off_policy_supervision_positions": at(lambda z: z["on"] & ~z["e"]),
        "missing_eligible_positions": at(lambda z: ~z["on"] & z["e"]),
    }).drop("_cells", "_categories")


def audit_labels(traces: DataFrame, labels: DataFrame, policy: str, unmatched: bool = False) -> DataFrame:
    """Audit a table ``example_id, labels`` against one policy.

    With ``unmatched`` a trace without labels and labels without a trace are rows
    too, with the error code ``labels.missing`` or ``trace.missing`` and no audit.
    """
    require_policy(policy)
    if not unmatched:
        return policy_audits(traces.join(labels, "example_id").withColumn("policy", F.lit(policy)))
    sides = traces.withColumn("_trace", F.lit(True)).join(labels.withColumn("_labels", F.lit(True)), "example_id", "full_outer")
    absent = F.when(F.col("_trace").isNull(), "trace.missing").when(F.col("_labels").isNull(), "labels.missing")
    out = policy_audits(sides.withColumns({"policy": F.lit(policy), "_absent": absent}).drop("_trace", "_labels"))
    given = {"example_id", "policy", "error_code", "_absent", *traces.columns, *labels.columns}
    alone = F.col("_absent").isNotNull()
    return out.withColumns({
        "error_code": F.coalesce("_absent", "error_code"), **{c: F.when(~alone, F.col(c)) for c in out.columns if c not in given}}).drop("_absent")


def with_policies(traces: DataFrame) -> DataFrame:
    """One row per trace and policy, with that policy's labels."""
    out = traces.withColumn("policy", F.explode(F.array(*map(F.lit, S.POLICIES))))
    return out.withColumn("labels", build_labels(F.col("trace"), F.col("messages"), F.col("policy")))


def _policy_struct(policy: str, labels: Column) -> Column:
    """Row-local audit of ``labels`` against a policy, in report form.

    Every list and count is read off the labels; only eligibility comes from the
    token categories.
    """
    good = lambda c: (c != "padding") if policy == S.ALL_TOKENS else (c == "assistant")

    def report(l: Column) -> Column:
        cells = F.zip_with(F.col("_categories"), l, lambda c, x: F.struct(
            c.alias("c"), good(c).alias("e"), (x != S.IGNORE_INDEX).alias("on")))
        return let(cells, lambda z: body(l, z))

    def body(l: Column, z: Column) -> Column:
        count = lambda test: F.size(F.filter(z, test))
        at = lambda test: positions_where(z, lambda x, i: test(x))
        return F.struct(
            at(lambda x: x["on"] & ~x["e"] & (x["c"] == "boundary")).alias("boundary_leakage_positions"),
            count(lambda x: x["on"] & (x["c"] == "boundary")).alias("boundary_supervised_token_count"),
            count(lambda x: x["e"]).alias("eligible_token_count"),
            count(lambda x: ~x["on"]).alias("ignored_token_count"),
            l.alias("labels"),
            labels_sha256(l).alias("labels_sha256"),
            at(lambda x: ~x["on"] & x["e"]).alias("missing_eligible_positions"),
            at(lambda x: x["on"] & ~x["e"]).alias("off_policy_supervision_positions"),
            at(lambda x: x["on"] & (x["c"] == "padding")).alias("padding_leakage_positions"),
            F.lit(policy).alias("policy"),
            supervised_runs(l).alias("supervised_runs"),
            count(lambda x: x["on"]).alias("supervised_token_count"),
        )

    return let(labels, report)


def audit_traces(traces: DataFrame, labels: dict[str, Column] | None = None) -> DataFrame:
    """One nested audit row per valid trace, both policies inside.

    The labels are those the policies build, or the columns given for a policy.
    :func:`invariant_violations` says where built labels break an invariant.
    """
    built = {p: build_labels(F.col("trace"), F.col("messages"), p) for p in S.POLICIES} | (labels or {})
    out = trace_summary(traces).withColumn("_categories", token_categories(F.col("trace"), F.col("messages")))
    out = out.withColumns({
        "empty_assistant_message_indices": empty_assistant_indices(F.col("trace"), F.col("messages")),
        "input_sha256": trace_sha256(F.col("example_id"), F.col("messages"), F.col("trace")),
        **{p: _policy_struct(p, built[p]) for p in S.POLICIES},
    })
    failed = F.size("empty_assistant_message_indices") > 0
    return out.select(
        "example_id", "input_sha256",
        F.when(failed, "fail").otherwise("pass").alias("status"),
        F.struct(
            "empty_assistant_message_indices",
            compact_codes((failed, "assistant_target.empty")).alias("issue_codes"),
        ).alias("diagnostics"),
        F.struct(
            "assistant_message_count", "message_count", "non_padding_token_count",
            "padding_token_count", "token_count",
        ).alias("trace_summary"),
        F.struct(S.ALL_TOKENS, S.ASSISTANT_ONLY).alias("policies"),
    )


def invariant_violations(audits: DataFrame) -> DataFrame:
    """``example_id, policy, code`` where the labels of :func:`audit_traces` do not fit their policy; empty when correct."""
    each = audits.select("example_id", F.explode(F.array(*[F.col(f"policies.{p}") for p in S.POLICIES])).alias("a"))
    lists = ("off_policy_supervision_positions", "missing_eligible_positions", "boundary_leakage_positions", "padding_leakage_positions")
    broken = F.col("a.supervised_token_count") != F.col("a.eligible_token_count")
    for name in lists:
        broken = broken | (F.size(f"a.{name}") > 0)
    return each.where(broken).select("example_id", "a.policy", F.lit("audit.internal_invariant").alias("code"))


def audit_report_json(audits: DataFrame) -> DataFrame:
    """Canonical JSON of each audit row and its hash."""
    no = F.lit(False)
    # The published scope of an audit.
    scope = F.struct(
        no.alias("causal_shift_or_loss_computed"),
        F.lit("caller-supplied-synthetic-pretokenized-json").alias("input_class"),
        no.alias("model_or_dataset_loaded"),
        F.lit(None).cast("string").alias("quality_metric"),
        no.alias("tokenizer_executed"),
        no.alias("tokenizer_mapping_attested"),
        no.alias("trainer_imported_or_executed"),
    )
    document = F.struct(
        "diagnostics", "example_id", "input_sha256", F.lit("loss-topology.audit").alias("kind"),
        "policies", F.lit(1).alias("schema_version"), scope.alias("scope"), "status", "trace_summary",
    )
    out = audits.select("example_id", "status", canonical_json(document).alias("report"))
    return out.withColumn("audit_sha256", line_sha256(F.col("report")))


def trace_sha256(example_id: Column, messages: Column, trace: Column) -> Column:
    """Content identity of a trace, whatever its key order or spacing was."""
    document = F.struct(
        F.struct(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
                 .alias("messages")).alias("conversation"),
        example_id.alias("example_id"),
        F.lit(S.TRACE_KIND).alias("kind"),
        F.lit(S.TRACE_SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            trace["padding_token_id"].alias("padding_token_id"),
            F.transform(trace["segments"], lambda s: F.struct(
                s["end"].alias("end"), s["kind"].alias("kind"),
                s["message_index"].alias("message_index"), s["start"].alias("start"))).alias("segments"),
            trace["token_ids"].alias("token_ids"),
        ).alias("trace"),
    )
    return line_sha256(canonical_json(document))


def inject_faults(rows: DataFrame, mutations: Column) -> DataFrame:
    """Apply ``array<struct<position, action>>`` to ``labels``.

    ``supervise`` restores the token id, ``ignore`` sets the ignore index; any
    other action or position leaves the label alone.
    """
    def apply(m: Column) -> Column:
        table = F.map_from_entries(F.transform(m, lambda x: F.struct(x["position"], x["action"])))
        return let(table, lambda t: F.zip_with(
            F.transform(F.col("labels"), lambda l, i: F.struct(l.alias("l"), F.try_element_at(t, i).alias("a"))),
            F.col("trace.token_ids"),
            lambda z, token: F.when(z["a"] == "supervise", token)
            .when(z["a"] == "ignore", S.IGNORE_INDEX).otherwise(z["l"]),
        ))

    return rows.withColumn("labels", let(mutations, apply))


def policy_comparison(audits: DataFrame) -> DataFrame:
    """Positions and runs of both policies side by side, one row per example."""
    detail = F.struct(
        "boundary_leakage_positions", "missing_eligible_positions", "off_policy_supervision_positions",
        "padding_leakage_positions", "supervised_runs", "supervised_token_count", "boundary_supervised_token_count")
    return audits.select("example_id", "policy", detail.alias("d")).groupBy("example_id").pivot(
        "policy", list(S.POLICIES)).agg(F.first("d"))


def token_grain(traces: DataFrame, labels: Column) -> DataFrame:
    """One row per position: ``example_id, pos, token_id, label, category``."""
    cells = F.arrays_zip(
        F.col("trace.token_ids").alias("token_id"), labels.alias("label"),
        token_categories(F.col("trace"), F.col("messages")).alias("category"))
    return traces.select("example_id", F.posexplode(cells).alias("pos", "z")).select(
        "example_id", "pos", "z.token_id", "z.label", "z.category")
