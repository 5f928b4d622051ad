"""Contract validation: one nullable ``error_code`` per row, first failure first."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.arrays import first_code, first_index, let
from labelscope.session import reliable_checkpoint


# --- messages ---------------------------------------------------------------


def message_code(role: Column, content: Column) -> Column:
    """Code of one typed message, before the running size limit."""
    return (
        F.when(role.isNull() | ~role.isin(*S.ROLES), "message.role")
        .when(content.isNull(), "message.content_type")
        .when(F.instr(content, "\x00") > 0, "message.content_nul")
        .when(F.octet_length(content) > S.MAX_MESSAGE_BYTES, "message.content_limit")
    )


def coded_messages(messages: Column) -> Column:
    """Typed messages with their byte size and own code attached."""
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"), m["content"].alias("content"),
            F.octet_length(m["content"]).alias("bytes"), message_code(m["role"], m["content"]).alias("code"),
        ),
    )


def message_count_code(messages: Column) -> Column:
    return F.when(messages.isNull(), "messages.type").when(
        ~F.size(messages).between(1, S.MAX_MESSAGES), "messages.count")


def total_limit_index(messages: Column) -> Column:
    """Index of the message at which the running content size passes its limit."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))

    def add(acc: Column, m: Column) -> Column:
        total = acc["total"] + F.coalesce(m["bytes"], F.lit(0)).cast("bigint")
        return F.struct(
            total.alias("total"), (acc["i"] + 1).alias("i"),
            F.coalesce(acc["at"], F.when(total > S.MAX_CONTENT_BYTES, acc["i"])).alias("at"),
        )

    return F.aggregate(messages, start, add, lambda acc: acc["at"])


def message_codes(messages: Column) -> Column:
    """First failing message decides; its own checks precede the running total."""
    own_at = first_index(messages, lambda m, i: m["code"].isNotNull())
    return let(
        F.struct(own_at.alias("own"), total_limit_index(messages).alias("total")),
        lambda x: F.when(x["own"].isNotNull() & (x["total"].isNull() | (x["own"] <= x["total"])),
                         F.get(F.transform(messages, lambda m: m["code"]), x["own"]))
        .when(x["total"].isNotNull(), "messages.content_limit"),
    )


def turn_order_code(roles: Column) -> Column:
    """Optional leading system turn, then user/assistant pairs to the end."""
    def check(r: Column) -> Column:
        first = F.when(F.get(r, F.lit(0)) == "system", 1).otherwise(0)
        expected = F.transform(
            r, lambda role, i: F.when((i == 0) & (role == "system"), True)
            .otherwise(role == F.when((i - first) % 2 == 0, "user").otherwise("assistant")))
        ordered = F.forall(expected, lambda ok: ok) & (F.size(r) > first) & (F.get(r, F.size(r) - 1) == "assistant")
        return F.when(~F.coalesce(ordered, F.lit(False)), "messages.turn_order")

    return let(roles, check)


def conversation_code(messages: Column) -> Column:
    """Code of an assembled conversation (``coded_messages`` form)."""
    return let(messages, lambda m: F.coalesce(
        message_count_code(m), message_codes(m), turn_order_code(F.transform(m, lambda x: x["role"]))))


# --- pretokenized traces ----------------------------------------------------


def token_code(trace: Column) -> Column:
    ids = trace["token_ids"]
    return (
        F.when(trace.isNull(), "trace.type")
        .when(ids.isNull(), "token_ids.type")
        .when(~F.size(ids).between(1, S.MAX_TOKENS), "token_ids.count")
        .when(~F.forall(ids, lambda t: t.isNotNull() & (t >= 0)), "token_ids.item")
        .when(trace["padding_token_id"].isNull() | (trace["padding_token_id"] < 0), "padding_token_id")
    )


def segment_count_code(segments: Column, message_count: Column) -> Column:
    return F.when(segments.isNull(), "segments.type").when(
        (F.size(segments) > S.MAX_SEGMENTS) | (F.size(segments) != 3 * message_count + 3), "segments.count")


def segment_shape_code(segments: Column) -> Column:
    bad = lambda v: v.isNull() | (v < 0) | (v > S.MAX_TOKENS)
    return first_code(F.transform(
        segments,
        lambda s: F.when(s["kind"].isNull(), "segment.kind")
        .when((s["message_index"] < 0) | (s["message_index"] >= S.MAX_MESSAGES), "segment.message_index")
        .when(bad(s["start"]), "segment.start")
        .when(bad(s["end"]), "segment.end"),
    ))


def expected_segment(i: Column, count: Column) -> Column:
    """Kind and message index every position of the segment list must have."""
    inner = F.array(*map(F.lit, ("message_start", "message_content", "message_end")))
    middle = (i > 0) & (i < count - 2)
    return F.struct(
        F.when(i == 0, "prefix_special").when(i == count - 2, "suffix_special")
        .when(i == count - 1, "padding").otherwise(F.get(inner, (i - 1) % 3)).alias("kind"),
        F.when(middle, F.floor((i - 1) / 3).cast("int")).alias("message_index"),
    )


def segment_sequence_code(segments: Column) -> Column:
    """Whether kinds and message indices follow the only allowed order."""
    return let(segments, lambda s: F.when(
        first_index(s, lambda x, i: ~_identity_holds(x, i, F.size(s))).isNotNull(), "segments.sequence"))


def _identity_holds(s: Column, i: Column, count: Column) -> Column:
    want = expected_segment(i, count)
    return s["kind"].eqNullSafe(want["kind"]) & s["message_index"].eqNullSafe(want["message_index"])


def segment_layout_code(segments: Column, token_count: Column) -> Column:
    """Sequence, coverage, range and empty-boundary checks, earliest segment first."""
    def per_segment(bound: Column) -> Column:
        s, n = bound["s"], bound["n"]
        codes = F.transform(
            s,
            lambda x, i: F.when(~_identity_holds(x, i, F.size(s)), "segments.sequence")
            .when(x["start"] != F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]), "segments.coverage")
            .when((x["end"] < x["start"]) | (x["end"] > n), "segments.range")
            .when(x["kind"].isin("message_start", "message_end") & (x["end"] == x["start"]), "segments.boundary_empty"),
        )
        last = F.get(s, F.size(s) - 1)
        return F.coalesce(first_code(codes), F.when(last["end"] != n, "segments.coverage"))

    return let(F.struct(segments.alias("s"), token_count.alias("n")), per_segment)


def padding_code(trace: Column) -> Column:
    def check(t: Column) -> Column:
        start = F.get(t["segments"], F.size(t["segments"]) - 1)["start"]
        tail = F.slice(t["token_ids"], start + 1, F.size(t["token_ids"]))
        return F.when(start == 0, "trace.non_padding_empty").when(
            F.exists(tail, lambda x: x != t["padding_token_id"]), "trace.padding_mismatch")

    return let(trace, check)


def trace_code(trace: Column, message_count: Column) -> Column:
    """Code of a typed trace body against its conversation."""
    return let(F.struct(trace.alias("t"), message_count.alias("n")), lambda x: F.coalesce(
        token_code(x["t"]),
        segment_count_code(x["t"]["segments"], x["n"]),
        segment_shape_code(x["t"]["segments"]),
        segment_layout_code(x["t"]["segments"], F.size(x["t"]["token_ids"])),
        padding_code(x["t"]),
    ))


def example_id_code(example_id: Column) -> Column:
    return F.when(~F.coalesce(example_id.rlike(S.ID_PATTERN), F.lit(False)), "example_id")


def validate_traces(traces: DataFrame) -> DataFrame:
    """Adds ``error_code`` to typed traces (``schemas.TRACES``)."""
    return traces.withColumn("error_code", F.coalesce(
        example_id_code(F.col("example_id")),
        conversation_code(coded_messages(F.col("messages"))),
        trace_code(F.col("trace"), F.size("messages")),
    ))


# --- source/target cases ----------------------------------------------------


def case_code(case_id: Column, source: Column, target: Column, max_length: Column) -> Column:
    unusable = lambda t: t.isNull() | (t == "") | (F.instr(t, "\x00") > 0)
    return (
        F.when(~F.coalesce(case_id.rlike(S.ID_PATTERN), F.lit(False)), "case_id")
        .when(unusable(source) | unusable(target), "text.value")
        .when((F.octet_length(source) > S.MAX_TEXT_BYTES) | (F.octet_length(target) > S.MAX_TEXT_BYTES), "text.size")
        .when(max_length.isNull(), "max_length.type")
        .when(~max_length.between(S.MIN_MODEL_LENGTH, S.MAX_MODEL_LENGTH), "max_length.range")
    )


def validate_cases(cases: DataFrame) -> DataFrame:
    return cases.withColumn(
        "error_code", case_code(F.col("case_id"), F.col("source"), F.col("target"), F.col("max_length")))


# --- quarantine -------------------------------------------------------------


def allowlisted(code: Column, allowed=S.TRACE_ERROR_CODES + S.CASE_ERROR_CODES) -> Column:
    """Codes outside the known set become ``internal.error``."""
    return F.when(code.isNull() | code.isin(*allowed), code).otherwise("internal.error")


def redact(rejects: DataFrame, key: str) -> DataFrame:
    """Only the record key and a known code leave quarantine."""
    return rejects.select(key, allowlisted(F.col("error_code")).alias("error_code"))


def quarantine_split(coded: DataFrame, key: str, materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows without their code, and redacted rejects.

    With ``materialize`` the validated rows are checkpointed first, so writing
    both sides validates once.
    """
    rows = reliable_checkpoint(coded) if materialize else coded
    valid = rows.where(F.col("error_code").isNull()).drop("error_code")
    return valid, redact(rows.where(F.col("error_code").isNotNull()), key)
