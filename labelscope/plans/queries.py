"""Registered queries: every operator over the whole conversation and document tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope import schemas as S
from labelscope.functions import bpe, text, unicode
from labelscope.functions.arrays import joined, let
from labelscope.functions.canonical import labels_sha256, line_sha256
from labelscope.functions.semantic_json import semantic_json_sha256
from labelscope.operators import batched as A
from labelscope.operators import boundary as B
from labelscope.operators import contract as V
from labelscope.operators import digests as N
from labelscope.operators import ordering as O
from labelscope.operators import preprocess as P
from labelscope.operators import reconcile as R
from labelscope.operators import seams as M
from labelscope.operators import sweep as G
from labelscope.operators import tokens as K
from labelscope.operators import topology as L
from labelscope.plans import corpus
from labelscope.session import reliable_checkpoint, shared_folder, ship_package
from labelscope.sources.documents import decode_cases, decode_manifests, decode_traces, read_cases, read_traces
from labelscope.sources.files import file_inventory, read_lines, walk_files, write_lines
from labelscope.sources.tables import read_manifest, read_sft, write_reports, write_sweep_csv

MERGES = (("t", "h"), ("th", "e"), ("i", "n"), ("in", "g"), ("e", "r"))
TOKENIZER = bpe.open_text_tokenizer(MERGES)
LIMIT = 256
SWEEP = (64, 128, 256, 512)
PROBES = ("the end", "h", "\u00e9", "\u0301 tail")
PAD = 0
#: Reports in a row group of a stored file. A reader unpacks a group at once, up to 4,096 rows of it, and a report takes up to some MB.
STORED_ROWS = 32
#: Placeholders for the identity and scope blocks of a report.
IDENTITY = ({"tokenizer": "open-text"}, {"corpus": True})


# --- inputs -------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def _documents(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _conversations(spark, d) -> DataFrame:
    return corpus.assemble_conversations(_turns(spark, d))


def _traces(spark, d) -> DataFrame:
    return corpus.valid_traces(_turns(spark, d))


def _quiet_traces(spark, d) -> DataFrame:
    """Traces with every fifth reply blanked, so some targets are empty."""
    blank = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0)
    turns = _turns(spark, d).withColumn("text", F.when(blank, "").otherwise(F.col("text")))
    return corpus.valid_traces(turns)


def _pairs(spark, d) -> DataFrame:
    return corpus.reply_pairs(_turns(spark, d), LIMIT)


def _reports(spark, d) -> DataFrame:
    return B.boundary_report(_pairs(spark, d).select("case_id", "source", "target", "max_length"), TOKENIZER)


def _stored_reports(spark, d) -> DataFrame:
    """Reports written and read again: as Parquet they take a small part of what a checkpoint of their rows does."""
    folder = shared_folder(spark, "stored")
    _reports(spark, d).write.option("parquet.block.row.count.limit", STORED_ROWS).parquet(folder)
    return spark.read.parquet(folder)


def _flat(df: DataFrame) -> DataFrame:
    """Scalar output: ints widened, arrays joined."""
    def column(f: T.StructField):
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return joined(F.col(f.name)).alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def _runs(column):
    return F.transform(column, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))


# --- prompts and cases ----------------------------------------------------------


def sft_prompts(spark, d):
    rows = _pairs(spark, d).select(
        "case_id", F.concat(F.lit(" \t"), "source", F.lit("\n ")).alias("instruction"), F.col("target").alias("output"))
    return P.render_pairs(rows).select("case_id", "source", "target")


def concatenated_pairs(spark, d):
    return B.concat_pair(_pairs(spark, d)).select("case_id", F.md5("combined").alias("combined_md5"), "boundary")


def case_identities(spark, d):
    return B.input_identity(_pairs(spark, d))


def case_codes(spark, d):
    cases = _pairs(spark, d)
    turn = F.col("turn")
    broken = cases.select(
        "conv_id", "turn",
        F.when(turn == 1, F.upper("case_id")).otherwise(F.col("case_id")).alias("case_id"),
        F.when(turn == 2, "").otherwise(F.col("source")).alias("source"),
        F.when(turn == 3, F.repeat("target", 9000)).otherwise(F.col("target")).alias("target"),
        F.when(turn == 4, 1).when(turn == 5, F.lit(None)).otherwise(F.col("max_length")).alias("max_length"))
    return V.validate_cases(broken).select("conv_id", "turn", "error_code")


# --- contract -------------------------------------------------------------------


def message_codes(spark, d):
    turns = _turns(spark, d)
    odd = turns.withColumns({
        "role": F.when(F.col("conv_id") % 11 == 3, "tool").otherwise(F.col("role")),
        "text": F.when(F.col("turn") == 3, F.repeat("text", 60)).otherwise(F.col("text")),
    })
    return odd.select("conv_id", "turn", V.message_code(F.col("role"), F.col("text")).alias("error_code"))


def content_limits(spark, d):
    """Running size limit with every text repeated up to just under its own limit."""
    copies = F.greatest(F.lit(1), F.floor(F.lit(8192) / F.greatest(F.lit(1), F.octet_length("text")))).cast("int")
    turns = _turns(spark, d).withColumn("text", F.repeat("text", copies))
    long = turns.unionByName(turns.withColumn("turn", F.col("turn") + 100))
    return corpus.assemble_conversations(long).select("conv_id", "error_code")


def conversation_codes(spark, d):
    return _conversations(spark, d).select("conv_id", "error_code")


def turn_order_codes(spark, d):
    return corpus.turn_orders(_turns(spark, d))


def _stretched(spark, d) -> DataFrame:
    """The turn table with gaps between turns, and with conversations of 65, 66 and thousands of turns.

    Every third conversation goes into one of a few long ones, repeated at far
    apart turns; two more take 65 and 66 turns of the table in order.
    """
    turns = _turns(spark, d)
    gapped = turns.where("conv_id % 3 <> 0").withColumn("turn", F.col("turn") * 3 + F.col("conv_id") % 5)
    long = turns.where("conv_id % 3 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).select(
        (-1 - F.col("conv_id") % 2).alias("conv_id"), (F.col("conv_id") * 64 + F.col("turn") + F.col("k") * 1_000_000).alias("turn"), "role", "text")
    fixed = turns.where("turn < 2 and role in ('user', 'assistant') and conv_id < 40").withColumn("c", F.explode(F.expr("array(-65L, -66L)"))).select(
        F.col("c").alias("conv_id"), (F.col("conv_id") * 2 + F.col("turn")).alias("turn"), "role", "text")
    size = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return gapped.unionByName(long).unionByName(
        fixed.withColumn("_n", size).where("_n <= -conv_id").drop("_n"))


def long_conversation_codes(spark, d):
    return corpus.assemble_conversations(_stretched(spark, d)).select("conv_id", "error_code", F.coalesce(F.size("messages"), F.lit(0)).cast("bigint").alias("messages"))


def long_turn_orders(spark, d):
    return corpus.turn_orders(_stretched(spark, d))


def gapped_reply_pairs(spark, d):
    return corpus.reply_pairs(_stretched(spark, d), LIMIT).select(
        "conv_id", "turn", F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"))


def gated_traces(spark, d):
    """Traces of conversations with many short words: over the token limit, they are no audit's input."""
    words = F.when(F.col("conv_id") % 5 == 0, F.repeat(F.lit("a "), 2100)).otherwise(F.col("text"))
    return corpus.coded_traces(_turns(spark, d).withColumn("text", words)).select("example_id", "error_code")


def quarantine_counts(spark, d):
    coded = _conversations(spark, d).select("conv_id", V.allowlisted(F.col("error_code")).alias("error_code"))
    return coded.groupBy(F.coalesce("error_code", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("conversations"))


def redacted_rejects(spark, d):
    renamed = _conversations(spark, d).withColumn(
        "error_code", F.when(F.col("conv_id") % 3 == 0, F.concat("error_code", F.lit(".new"))).otherwise(F.col("error_code")))
    return V.quarantine_split(renamed, "conv_id")[1]


def trace_exit_codes(spark, d):
    convs = _conversations(spark, d)
    return convs.select(
        "conv_id", B.exit_code(F.lit("pass"), F.col("error_code").isNotNull()).cast("bigint").alias("exit_code"))


def _damaged(spark, d) -> DataFrame:
    """Valid traces with one fault each, chosen by conversation id."""
    rows = _traces(spark, d).withColumn("kind", F.regexp_extract("example_id", r"(\d+)", 1).cast("bigint") % 10)
    k, t = F.col("kind"), F.col("trace")
    segs, ids = t["segments"], t["token_ids"]
    n = F.size(ids)
    def edit(fault, at, **changes):
        return F.when(k == fault, F.transform(segs, lambda s, i: F.when(i == at, F.struct(
            *[changes.get(f, lambda s: s[f])(s).alias(f) for f in ("kind", "message_index", "start", "end")])).otherwise(s)))
    wide = lambda v: v.cast("int")
    new_segments = F.coalesce(
        F.when(k == 3, F.slice(segs, F.lit(1), F.size(segs) - 1)),
        edit(4, 1, kind=lambda s: F.lit("message_content")),
        edit(5, 1, start=lambda s: wide(s["start"] + 1)),
        edit(6, 0, end=lambda s: wide(n + 1)),
        edit(7, 1, end=lambda s: wide(s["start"])),
        edit(8, 2, start=lambda s: F.lit(-1)),
        segs)
    new_ids = F.when(k == 1, F.concat(F.array(F.lit(-1)), F.slice(ids, F.lit(2), n))).when(
        k == 9, F.concat(F.slice(ids, F.lit(1), n - 1), F.array(F.lit(7)))).otherwise(ids)
    return rows.withColumn("trace", F.struct(
        new_ids.alias("token_ids"), F.when(k == 2, -1).otherwise(t["padding_token_id"]).alias("padding_token_id"),
        new_segments.alias("segments")))


def trace_codes(spark, d):
    return V.validate_traces(_damaged(spark, d)).select("example_id", "error_code")


def trace_part_codes(spark, d):
    rows = _damaged(spark, d)
    t = F.col("trace")
    return rows.select(
        "example_id",
        V.token_code(t).alias("token_code"),
        V.segment_count_code(t["segments"], F.size("messages")).alias("count_code"),
        V.segment_shape_code(t["segments"]).alias("shape_code"),
        V.segment_sequence_code(t["segments"]).alias("sequence_code"),
    )


def _trace_documents(spark, d) -> DataFrame:
    """Raw JSON of every trace, some of it broken on purpose."""
    convs = corpus.conversation_traces(_conversations(spark, d))
    body = F.to_json(F.struct(
        F.struct("messages").alias("conversation"), "example_id", F.lit(S.TRACE_KIND).alias("kind"),
        F.lit(1).alias("schema_version"), "trace"), {"ignoreNullFields": "false"})
    k = F.regexp_extract("example_id", r"(\d+)", 1).cast("bigint") % 8
    broken = (
        F.when(k == 1, F.replace(body, F.lit('"schema_version":1'), F.lit('"schema_version":1.0')))
        .when(k == 2, F.replace(body, F.lit('"schema_version":1'), F.lit('"schema_version":1,"schema_version":1')))
        .when(k == 3, F.replace(body, F.lit('"schema_version":1'), F.lit('"schema_version":1,"note":"x"')))
        .when(k == 4, F.replace(body, F.lit('"padding_token_id":0'), F.lit('"padding_token_id":"0"')))
        .when(k == 5, F.substring(body, 1, 40))
        .otherwise(body))
    return convs.select(F.col("example_id").alias("record_key"), broken.cast("binary").alias("payload"), F.lit(False).alias("oversize"))


def trace_document_codes(spark, d):
    return decode_traces(_trace_documents(spark, d)).select("record_key", "error_code")


def _case_documents(spark, d) -> DataFrame:
    """Raw JSON of every case, some of it broken on purpose."""
    pairs = _pairs(spark, d)
    body = F.to_json(F.struct("case_id", "max_length", F.lit(S.CASE_SCHEMA_VERSION).alias("schema_version"), "source", "target"))
    k = F.col("conv_id") % 6
    broken = (
        F.when(k == 1, F.replace(body, F.lit('"max_length":256'), F.lit('"max_length":true')))
        .when(k == 2, F.replace(body, F.lit('"max_length":256'), F.lit('"max_length":1')))
        .when(k == 3, F.replace(body, F.lit("case-v1"), F.lit("case-v2")))
        .when(k == 4, F.concat(body, F.lit("}")))
        .otherwise(body))
    return pairs.select(F.col("case_id").alias("record_key"), broken.cast("binary").alias("payload"), F.lit(False).alias("oversize"))


def case_document_codes(spark, d):
    return decode_cases(_case_documents(spark, d)).select("record_key", "error_code")


# --- topology ---------------------------------------------------------------------


def trace_summaries(spark, d):
    return _flat(L.trace_summary(_traces(spark, d)).drop("messages", "trace"))


def padding_starts(spark, d):
    return _flat(_traces(spark, d).select("example_id", L.padding_start(F.col("trace")).alias("padding_start")))


def eligible_positions(spark, d):
    rows = _traces(spark, d)
    pos = lambda policy: L.eligible_positions(F.col("trace"), F.col("messages"), policy)
    return _flat(rows.select(
        "example_id", pos(S.ALL_TOKENS).alias("all_tokens"), pos(S.ASSISTANT_ONLY).alias("assistant_only")))


def boundary_positions(spark, d):
    return _flat(_traces(spark, d).select(
        "example_id", L.positions_for_kinds(F.col("trace"), S.BOUNDARY_KINDS).alias("positions")))


def token_category_counts(spark, d):
    """Token grain: positions per category over the corpus."""
    rows = _traces(spark, d)
    grain = L.token_grain(rows, L.build_labels(F.col("trace"), F.col("messages"), S.ASSISTANT_ONLY))
    return grain.groupBy("category").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("label") != S.IGNORE_INDEX).alias("supervised"))


def built_labels(spark, d):
    return _flat(L.with_policies(_traces(spark, d)).select("example_id", "policy", "labels"))


def label_codes(spark, d):
    rows = L.with_policies(_traces(spark, d))
    labels = F.col("labels")
    damaged = (
        F.when(F.size("messages") % 4 == 0, F.slice(labels, F.lit(1), F.size(labels) - 1))
        .when(F.size("messages") % 4 == 1, F.transform(labels, lambda l, i: F.when(i == 2, 5).otherwise(l)))
        .when(F.size("messages") % 4 == 2, F.transform(labels, lambda l, i: F.when(i == 2, F.lit(None)).otherwise(l)))
        .otherwise(labels))
    return rows.select("example_id", "policy", L.label_code(F.col("trace.token_ids"), damaged).alias("error_code"))


def _audits(spark, d):
    return L.policy_audits(L.with_policies(_traces(spark, d)))


def label_counts(spark, d):
    return _flat(_audits(spark, d).select(
        "example_id", "policy", "eligible_token_count", "supervised_token_count", "ignored_token_count",
        "boundary_supervised_token_count"))


def supervised_positions(spark, d):
    rows = L.with_policies(_traces(spark, d))
    return _flat(rows.select("example_id", "policy", L.supervised_positions(F.col("labels")).alias("positions")))


def supervised_runs(spark, d):
    rows = L.with_policies(_traces(spark, d))
    return _flat(rows.select("example_id", "policy", _runs(L.supervised_runs(F.col("labels"))).alias("runs")))


def token_runs(spark, d):
    """Supervised runs one token a row, in blocks of 32 positions so that runs cross borders."""
    tokens, segments, roles = K.trace_rows(_traces(spark, d))
    labelled = None
    for policy in S.POLICIES:
        one = K.policy_labels(K.categories(tokens, segments, roles, 32), policy).withColumn("policy", F.lit(policy))
        labelled = one if labelled is None else labelled.unionByName(one)
    return K.supervised_runs(labelled, ("example_id", "policy"), 32).withColumnsRenamed({"start": "run_start", "end": "run_end"})


def token_categories(spark, d):
    """Tokens of each category one token a row."""
    tokens, segments, roles = K.trace_rows(_traces(spark, d))
    return K.categories(tokens, segments, roles, 32).groupBy("example_id", "category").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("pos").alias("pos_sum"), F.sum(F.col("token_id").cast("long")).alias("id_sum"))


def label_digests(spark, d):
    return L.with_policies(_traces(spark, d)).select(
        "example_id", "policy", labels_sha256(F.col("labels")).alias("labels_sha256"))


def empty_targets(spark, d):
    audits = L.audit_traces(_quiet_traces(spark, d))
    return _flat(audits.select(
        "example_id", "status", F.col("diagnostics.empty_assistant_message_indices").alias("indices"),
        F.col("diagnostics.issue_codes").alias("issue_codes")))


def supplied_label_audit(spark, d):
    """All-token labels audited against the assistant-only policy."""
    traces = _traces(spark, d)
    labels = _traces(spark, d).select(
        "example_id", L.build_labels(F.col("trace"), F.col("messages"), S.ALL_TOKENS).alias("labels"))
    audits = L.audit_labels(traces, labels, S.ASSISTANT_ONLY)
    return _flat(audits.select(
        "example_id", "boundary_leakage_positions", "padding_leakage_positions",
        "off_policy_supervision_positions", "missing_eligible_positions"))


def unmatched_labels(spark, d):
    """Labels of some traces are not there, and some labels have no trace."""
    traces = _traces(spark, d)
    number = F.regexp_extract("example_id", "[0-9]+", 0).cast("long") % 4
    labels = traces.select(
        F.when(number == 1, F.concat(F.lit("other-"), "example_id")).otherwise(F.col("example_id")).alias("example_id"),
        L.build_labels(F.col("trace"), F.col("messages"), S.ASSISTANT_ONLY).alias("labels"), number.alias("n")).where("n <> 2").drop("n")
    audits = L.audit_labels(traces, labels, S.ASSISTANT_ONLY, unmatched=True)
    return _flat(audits.select("example_id", F.col("error_code").alias("code"), "missing_eligible_positions", F.size("labels").alias("tokens")))


def trace_audit_rollup(spark, d):
    audits = L.audit_traces(_quiet_traces(spark, d))
    p = lambda f: F.sum(F.col(f"policies.assistant_only.{f}")).alias(f)
    return audits.groupBy("status").agg(
        F.count(F.lit(1)).alias("traces"), p("supervised_token_count"), p("ignored_token_count"),
        F.sum("trace_summary.padding_token_count").alias("padding_token_count"))


def _damaged_audits(spark, d):
    """Audits of labels whose first position is supervised, and whose first target is not, in every third trace."""
    rows = _traces(spark, d)
    built = L.build_labels(F.col("trace"), F.col("messages"), S.ASSISTANT_ONLY)
    hit = F.regexp_extract("example_id", r"(\d+)", 1).cast("bigint") % 3
    # Both are bound: a lambda would work them out again for every label.
    spots = lambda labels: F.struct(hit.alias("hit"), F.array_min(L.supervised_positions(labels)).alias("first"))
    changed = let(built, lambda b: let(spots(b), lambda x: F.transform(b, lambda l, i: F.when((x["hit"] == 0) & (i == 0), 1).when(
        (x["hit"] == 1) & (i == x["first"]), S.IGNORE_INDEX).otherwise(l))))
    return L.audit_traces(rows, {S.ASSISTANT_ONLY: changed})


def audit_invariants(spark, d):
    """No audit of built labels breaks an invariant, and damaged labels do."""
    sound = L.invariant_violations(L.audit_traces(_traces(spark, d))).withColumn("labels", F.lit("built"))
    return sound.unionByName(L.invariant_violations(_damaged_audits(spark, d)).withColumn("labels", F.lit("damaged")))


def trace_audit_reports(spark, d):
    return L.audit_report_json(L.audit_traces(_traces(spark, d))).select("example_id", "status", "audit_sha256")


def trace_digests(spark, d):
    return _traces(spark, d).select(
        "example_id", L.trace_sha256(F.col("example_id"), F.col("messages"), F.col("trace")).alias("trace_sha256"))


def _faulted(spark, d):
    rows = L.with_policies(_traces(spark, d)).where(F.col("policy") == S.ASSISTANT_ONLY)
    last = F.size("trace.token_ids") - 1
    fault = lambda at, what: F.struct(at.alias("position"), F.lit(what).alias("action"))
    first_target = F.array_min(L.supervised_positions(F.col("labels")))
    return L.inject_faults(rows, F.array(
        fault(F.lit(0), "supervise"), fault(last, "supervise"), fault(first_target, "ignore")))


def injected_faults(spark, d):
    audits = L.policy_audits(_faulted(spark, d))
    return _flat(audits.select(
        "example_id", "boundary_leakage_positions", "padding_leakage_positions",
        "off_policy_supervision_positions", "missing_eligible_positions", _runs(F.col("supervised_runs")).alias("runs")))


def policy_comparison(spark, d):
    wide = L.policy_comparison(_audits(spark, d))
    f = lambda policy, name: F.col(f"{policy}.{name}").cast("bigint")
    return wide.select(
        "example_id",
        f("all_tokens", "supervised_token_count").alias("all_supervised"),
        f("assistant_only", "supervised_token_count").alias("assistant_supervised"),
        f("all_tokens", "boundary_supervised_token_count").alias("all_boundary"),
        F.size("all_tokens.supervised_runs").cast("bigint").alias("all_runs"),
        F.size("assistant_only.supervised_runs").cast("bigint").alias("assistant_runs"))


# --- training preprocessing ---------------------------------------------------------


def token_lengths(spark, d):
    rows = P.tokenize(_documents(spark, d), {"text": "ids"}, TOKENIZER, 1 << 30)
    return _flat(P.token_lengths(rows, {"ids": "tokens"}).select("doc_id", "tokens"))


def masked_examples(spark, d):
    rows = P.preprocess_pairs(_pairs(spark, d), TOKENIZER, LIMIT, keep=("case_id",))
    return _flat(rows.select(
        "case_id", F.md5(joined(F.col("input_ids"))).alias("ids_md5"), F.md5(joined(F.col("labels"))).alias("labels_md5"),
        F.size(F.filter("labels", lambda l: l == S.IGNORE_INDEX)).alias("masked")))


def _batches(spark, d):
    pairs = corpus.reply_pairs(_stretched(spark, d), LIMIT)
    rows = P.preprocess_pairs(pairs, TOKENIZER, LIMIT, keep=("case_id", "conv_id", "turn"))
    return P.pad_collate(P.assign_batches(rows, ("conv_id", "turn"), batch_size=8, shard=batch_shard()), PAD)


def batch_shard():
    """Sixty-four conversations, or 4096 turns of one: numbers that meet merge two shards, and no more."""
    return F.floor(F.col("conv_id") / 64) * (1 << 20) + F.floor(F.col("turn") / 4096)


def padded_batches(spark, d):
    rows = _batches(spark, d)
    return _flat(rows.select(
        "case_id", "shard", "batch", F.size("input_ids").alias("width"),
        F.md5(joined(F.col("labels"))).alias("labels_md5")))


def dataset_order_batches(spark, d):
    """Batches that run through the table in order, over a table whose order begins with a hot key."""
    pairs = corpus.reply_pairs(_stretched(spark, d), LIMIT)
    rows = P.preprocess_pairs(pairs, TOKENIZER, LIMIT, keep=("case_id", "conv_id", "turn"))
    padded = P.pad_collate(O.dataset_batches(rows, ("conv_id", "turn"), 8).withColumn("shard", F.lit(0)), PAD)
    return _flat(padded.select("case_id", "place", "batch", F.size("input_ids").alias("width"), F.md5(joined(F.col("labels"))).alias("labels_md5")))


def _word_counts(batch):
    """A user's function: words and characters of a batch of texts."""
    return batch.assign(words=batch["text"].str.count(r"[^\x20\x09-\x0D]+"), chars=batch["text"].str.len(), rows=len(batch))


def mapped_batches(spark, d):
    """Whole texts through a function of batches of 7 rows, in the order of ids; only the last batch is shorter."""
    docs = _documents(spark, d).select("doc_id", "text")
    return A.ordered_map(docs, ("doc_id",), _word_counts, 7, "doc_id long, words long, chars long, rows long")


def attention_masks(spark, d):
    rows = _batches(spark, d)
    mask = P.attention_mask(F.col("input_ids"), PAD)
    return _flat(rows.select("case_id", F.size(F.filter(mask, lambda m: m)).alias("attended"), F.size(mask).alias("width")))


def sampled_examples(spark, d):
    return P.sample_examples(_pairs(spark, d), "case_id", 3, "7").select("case_id", "source", "target")


# --- boundary -------------------------------------------------------------------------


def nfc_documents(spark, d):
    """NFC of every whole text after pulling its accents apart."""
    rows = _documents(spark, d)
    for whole, parts in (("\u00e9", "e\u0301"), ("\u00fc", "u\u0308"), ("\u00e7", "c\u0327")):
        rows = rows.withColumn("text", F.replace("text", F.lit(whole), F.lit(parts)))
    return rows.select("doc_id", F.md5(unicode.nfc(F.col("text"))).alias("nfc_md5"))


def stripped_documents(spark, d):
    tail = F.when(F.col("doc_id") % 2 == 0, " \t \x1c\n").otherwise("")
    raw = _documents(spark, d).select("doc_id", F.concat("text", tail).alias("text"))
    kept = text.right_strip(F.col("text"))
    return _flat(raw.select(
        "doc_id", F.md5(kept).alias("stripped_md5"), (F.char_length("text") - F.char_length(kept)).alias("removed")))


def document_pieces(spark, d):
    """Piece counts over whole documents."""
    rows = _documents(spark, d).select("doc_id", TOKENIZER.pieces(F.col("text")).alias("pieces"))
    return _flat(rows.select(
        "doc_id", F.size("pieces").alias("pieces"),
        F.size(F.filter("pieces", lambda p: F.char_length(p) > 1)).alias("merged")))


def _decomposed_pairs(spark, d):
    """Pairs whose target starts with a combining accent, so NFC crosses the boundary."""
    return _pairs(spark, d).withColumns({
        "source": F.concat("source", F.lit("e")), "target": F.concat(F.lit("́"), "target")})


def normalization_snapshots(spark, d):
    rows = B.normalize_cases(_decomposed_pairs(spark, d))
    return _flat(rows.select(
        "case_id", "combined_raw_count", "combined_nfc_count",
        F.char_length("combined_normalized").alias("combined_normalized_count"), "combined_complete",
        B.cross_boundary_output_positions(
            F.col("combined_starts"), F.col("combined_ends"), F.char_length("combined_normalized"), F.col("boundary"),
        ).alias("cross_positions"),
        B.runtime_matches("combined").alias("runtime_matches")))


def encodings(spark, d):
    rows = B.three_encodings(_pairs(spark, d), TOKENIZER)
    digest = lambda name: F.md5(joined(F.col(f"{name}__ids"))).alias(f"{name}_md5")
    ends = F.transform("combined_truncated__offsets", lambda o: o["end"])
    return rows.select(
        "case_id", *[digest(n) for n in B.ENCODINGS], F.md5(joined(ends)).alias("offsets_md5"),
        bpe.exact_prefix("combined_full", "combined_truncated").alias("exact_prefix"))


def token_ownership(spark, d):
    rows = _reports(spark, d)
    count = lambda owner: F.size(F.filter("full_attribution", lambda t: t["ownership"] == owner)).alias(owner)
    return _flat(rows.select("case_id", *[count(o) for o in S.OWNERSHIPS]))


def nonprefix_ownership(spark, d):
    """Truncated encodings altered in their last token lose their attribution."""
    rows = B.three_encodings(_pairs(spark, d), TOKENIZER)
    names = {f"{n}__{v}" for n in B.ENCODINGS for v in bpe.VECTORS}
    supplied = rows.select(*[c for c in rows.columns if c not in names], *[bpe.as_struct(n) for n in B.ENCODINGS])
    cut = F.col("combined_truncated")
    altered = supplied.withColumn("combined_truncated", cut.withField("ids", F.concat(
        F.slice(cut["ids"], F.lit(1), F.size(cut["ids"]) - 1), F.array(F.lit(1024).cast("bigint")))))
    reports = B.report_from_encodings(reliable_checkpoint(altered), TOKENIZER)
    return _flat(reports.select(
        "case_id", "status", F.array_join("classifications", "|").alias("classifications"),
        F.array_join("diagnostics.indeterminate_reasons", "|").alias("reasons"),
        F.size(F.filter("truncated_attribution", lambda t: t["ownership"] == "ambiguous")).alias("ambiguous")))


def boundary_reasons(spark, d):
    """Cases that cannot be decided, and why: odd marks, a stripped separator, unknown tokens, altered pieces."""
    k = F.col("conv_id") % 5
    tail = F.when(k == 1, "\u1100").when(k == 2, "a\u0315\u0300").otherwise("")
    cases = _pairs(spark, d).select(
        "case_id", k.alias("kind"), F.concat("source", tail).alias("source"),
        F.concat(F.when(k == 1, "\u1161").otherwise(""), "target", F.when(k == 3, "\x1c").otherwise("")).alias("target"), "max_length")
    open_text = B.boundary_report(cases.where("kind in (1, 2, 3)").drop("kind"), TOKENIZER)
    pinned = B.boundary_report(cases.where("kind = 0").drop("kind"), bpe.pinned_tokenizer())
    encoded = B.three_encodings(cases.where("kind = 4").drop("kind"), TOKENIZER)
    names = {f"{n}__{v}" for n in B.ENCODINGS for v in bpe.VECTORS}
    supplied = encoded.select(*[c for c in encoded.columns if c not in names], *[bpe.as_struct(n) for n in B.ENCODINGS])
    altered = supplied.withColumns({n: F.col(n).withField("pieces", F.transform(
        F.col(n)["pieces"], lambda p, i: F.when(i == 1, F.concat(p, F.lit("?"))).otherwise(p))) for n in B.ENCODINGS})
    reports = open_text.unionByName(pinned).unionByName(B.report_from_encodings(reliable_checkpoint(altered), TOKENIZER))
    return reports.select("case_id", "status", F.array_join("diagnostics.indeterminate_reasons", "|").alias("reasons"))


def boundary_diagnostics(spark, d):
    r = _reports(spark, d)
    g = lambda f: F.col(f"diagnostics.{f}").alias(f)
    return _flat(r.select(
        "case_id", F.col("legacy_mask.cutoff").alias("cutoff"), g("oracle_cutoff"), g("prompt_leakage_positions"),
        g("masked_retained_target_positions"), g("cross_boundary_positions"), g("ambiguous_positions"),
        g("full_target_token_count"), g("retained_target_token_count"), g("supervised_target_token_count"),
        g("truncated_target_token_count"), g("elimination_causes"), g("indeterminate_reasons")))


def boundary_classes(spark, d):
    return _reports(spark, d).select(
        "case_id", "status", "primary_classification", F.array_join("classifications", "|").alias("classifications"))


def mask_positions(spark, d):
    r = _reports(spark, d)
    return _flat(r.select("case_id", F.size("legacy_mask.masked_positions").alias("masked"),
                          F.size("legacy_mask.supervised_positions").alias("supervised")))


def unicode_boundary_classes(spark, d):
    reports = B.boundary_report(_decomposed_pairs(spark, d), TOKENIZER)
    return _flat(reports.select(
        "case_id", "primary_classification", F.col("diagnostics.cross_boundary_positions").alias("cross")))


def report_digests(spark, d):
    """Canonical report hashes; the identity blocks are placeholders."""
    return B.report_json(_reports(spark, d), *IDENTITY).select(
        "case_id", "status", "report_sha256")


# --- reconciliation -----------------------------------------------------------------


def report_violations(spark, d):
    """Stored reports with one field changed, re-derived and compared."""
    stored = _stored_reports(spark, d)
    k = F.size("legacy_mask.masked_positions") % 4
    mask, diag = F.col("legacy_mask"), F.col("diagnostics")
    changed = stored.withColumns({
        "legacy_mask": F.when(k == 1, mask.withField("cutoff", mask["cutoff"] + 1)).otherwise(mask),
        "diagnostics": F.when(k == 2, diag.withField(
            "retained_target_token_count", diag["retained_target_token_count"] + 1)).otherwise(diag),
        "status": F.when(k == 3, "indeterminate").otherwise(F.col("status")),
    })
    return R.revalidate_reports(changed, TOKENIZER).groupBy(
        F.coalesce("first_code", F.lit("none")).alias("first_code")).agg(F.count(F.lit(1)).alias("reports"))


def report_violation_rows(spark, d):
    """Six kinds of damage to stored reports, from missing fields to attribution, and the first code of each."""
    stored = _stored_reports(spark, d)
    k = F.size("legacy_mask.masked_positions") % 7
    put = lambda at, section, field, value: {section: F.when(k == at, F.col(section).withField(field, value)).otherwise(F.col(section))}
    tokens = F.col("full_attribution")
    changed = stored.withColumns({
        "status": F.when(k != 0, F.col("status")),
        **put(1, "legacy_mask", "cutoff", F.lit(None).cast("int")),
        **put(2, "source_normalization", "raw_codepoint_count", F.lit(-1)),
        **put(5, "diagnostics", "full_target_token_count", F.lit(-1)),
        "full_attribution": F.when(k == 3, F.transform(tokens, lambda t, i: F.when(i == 0, t.withField("ownership", F.lit("nobody"))).otherwise(t)))
        .when(k == 4, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens),
    })
    # A filter would be pushed below the checks, with a copy of all of them.
    checked = reliable_checkpoint(R.revalidate_reports(changed, TOKENIZER).select("case_id", "first_code"))
    return checked.where(F.col("first_code").isNotNull())


def _inventory(spark, d):
    return _documents(spark, d).select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def file_drift(spark, d):
    """German files are gone, French ones grew, Spanish ones changed in place; some English ones are unread or changed their mode."""
    docs, lang = _documents(spark, d), F.col("lang")
    now = docs.where(lang != "de").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.encode(F.when(lang == "fr", F.concat("text", F.lit("!"))).when(lang == "es", F.replace("text", F.lit("e"), F.lit("a")))
                 .otherwise(F.col("text")), "UTF-8").alias("content"), (F.col("doc_id") % 11 == 0).alias("hidden"),
        F.when((lang == "en") & (F.col("doc_id") % 7 == 0), "100755").otherwise("100644").alias("git_mode"))
    now = now.select("path", "git_mode", F.octet_length("content").cast("bigint").alias("bytes"), F.when(~F.col("hidden"), F.col("content")).alias("content"))
    listed = _inventory(spark, d).withColumn("git_mode", F.lit("100644")).withColumn("path", F.when(F.octet_length("content") > 200, F.col("path"))
                                             .otherwise(F.concat(F.lit("old/"), "path")))
    return R.attest_files(now, R.file_identities(listed)).where(F.col("code").isNotNull())


def file_identities(spark, d):
    return R.file_identities(_inventory(spark, d))


def bound_identity(spark, d):
    return R.bind_identity(_inventory(spark, d), R.file_identities(_inventory(spark, d)), "doc/5")


def artifact_manifest(spark, d):
    return R.artifact_manifest(_inventory(spark, d))


def bound_paths(spark, d):
    """Five paths bound: as listed, changed, listed only, there only, and on neither side."""
    there = _inventory(spark, d).where(~F.col("path").isin("doc/2"))
    listed = R.file_identities(_inventory(spark, d).where(~F.col("path").isin("doc/3")).withColumn(
        "content", F.when(F.col("path") == "doc/1", F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content"))))
    out = None
    for path in ("doc/0", "doc/1", "doc/2", "doc/3", "doc/none"):
        one = R.bind_identity(there, listed, path)
        out = one if out is None else out.unionByName(one)
    return out


def unread_manifest(spark, d):
    """The manifest of a listing of which some files were not read."""
    files = _inventory(spark, d).withColumn("bytes", F.octet_length("content").cast("bigint"))
    hidden = F.md5("path") < "6"
    return R.artifact_manifest(files.withColumn("content", F.when(~hidden, F.col("content"))))


def golden_nulls(spark, d):
    """Hashes that are NULL on either side or both, and names on one side only."""
    docs, n = _documents(spark, d), F.col("doc_id") % 7
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name")
    digest = F.sha2("text", 256)
    expected = docs.where(n != 0).select(name, F.when(~n.isin(1, 2), digest).alias("sha256"))
    actual = docs.where(n != 3).select(name, F.when(~n.isin(1, 4), digest).alias("sha256"))
    return R.golden_drift(actual, expected)


def stored_golden_drift(spark, d):
    """Two stored inventories of whole texts of which one bucket in many differs."""
    docs, n = _documents(spark, d), F.col("doc_id") % 61
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name")
    paths = shared_folder(spark, "actual"), shared_folder(spark, "expected")
    actual = F.when(n == 3, F.sha2(F.concat("text", F.lit(".")), 256)).when(n != 4, F.sha2("text", 256))
    N.store_inventory(docs.where(n != 0).select(name, actual.alias("sha256")), paths[0], 8, 8)
    N.store_inventory(docs.where(n != 1).select(name, F.sha2("text", 256).alias("sha256")), paths[1], 8, 8)
    return N.stored_drift(spark, *paths)


def unexpected_results(spark, d):
    """Results nobody expected, expectations without a result, and NULL fields, over whole texts."""
    docs, n = _documents(spark, d), F.col("doc_id") % 5
    results = docs.where(n != 0).select("doc_id", F.md5("text").alias("digest"), F.when(n != 1, F.col("lang")).alias("lang"))
    expected = docs.where(n != 2).select("doc_id", F.when(n != 3, F.md5("text")).alias("digest"), F.when(n != 1, F.col("lang")).alias("lang"))
    return R.check_expectations(results, expected, "doc_id", ("digest", "lang"))


def semantic_props(spark, d):
    """Properties as stored, and inside documents with nesting, fractions, negative zeros and large numbers."""
    events = spark.read.parquet(f"{d}/events.parquet")
    wrapped = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(
        F.lit('{"z": [1, {"b": null, "a": true}], "p": '), "props", F.lit(', "é": "\\u0041/"}'))).when(F.col("event_id") % 4 == 2, F.concat(
            F.lit('[-0.0, 1.50, 2e3, -0, 12345678901, 1e9, '), "props", F.lit("]"))).otherwise(F.concat(F.lit('{"k": 1, "k": '), "props", F.lit("}")))
    return events.select("event_id", semantic_json_sha256(wrapped).alias("semantic_sha256"))


def golden_drift(spark, d):
    """German documents are new, French ones lost, Spanish ones changed."""
    docs, lang = _documents(spark, d), F.col("lang")
    name = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name")
    expected = docs.where(lang != "de").select(name, F.sha2("text", 256).alias("sha256"))
    actual = docs.where(lang != "fr").select(name, F.sha2(
        F.when(lang == "es", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return R.golden_drift(actual, expected)


def expectation_mismatches(spark, d):
    reports = _reports(spark, d).select("case_id", "status", "primary_classification")
    expected = _pairs(spark, d).select(
        "case_id", F.lit("pass").alias("status"), F.lit("aligned").alias("primary_classification"))
    return R.check_expectations(reports, expected, "case_id", ("status", "primary_classification"))


# --- sources and sinks: what is derived from the tables, written and read back ---------


def sft_rows(spark, d):
    """Training rows read from a table with more columns than they have."""
    folder = shared_folder(spark, "sft")
    _pairs(spark, d).select("case_id", F.col("source").alias("instruction"), F.col("target").alias("output"), "max_length").write.parquet(folder)
    return read_sft(spark, folder).select(F.md5("instruction").alias("instruction_md5"), F.md5("output").alias("output_md5"))


def _outcomes(valid, rejects):
    both = valid.select(F.lit("valid").alias("outcome")).union(rejects.select("error_code"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def trace_lines(spark, d):
    folder = shared_folder(spark, "traces")
    _trace_documents(spark, d).select(F.col("payload").cast("string")).write.text(folder)
    return _outcomes(*read_traces(spark, folder, "lines"))


def case_lines(spark, d):
    folder = shared_folder(spark, "cases")
    _case_documents(spark, d).select(F.col("payload").cast("string")).write.text(folder)
    return _outcomes(*read_cases(spark, folder, "lines"))


def stored_reports(spark, d):
    """Canonical report lines as a sink leaves them: compressed, since a report is a hundred times as long as its texts."""
    reports = B.report_json(_reports(spark, d), *IDENTITY)
    lines = spark.read.text(write_reports(reports, shared_folder(spark, "reports"), "1", "gzip"))
    return lines.select(line_sha256(F.col("value")).alias("report_sha256"))


def stored_sweep(spark, d):
    """All 19 columns as a CSV reader gets them back; an empty cell is NULL."""
    folder = shared_folder(spark, "sweep")
    table = _flat(G.sweep_table(_sweep(spark, d), *IDENTITY))
    write_sweep_csv(table, folder)
    rows = spark.read.option("header", True).csv(folder)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])


def _filed(spark, d) -> DataFrame:
    """Documents by folder: a source and a hundred ids each."""
    return _documents(spark, d).select("source", F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", "text")


def scanned_files(spark, d):
    """Files of whole texts, listed and hashed by executors, with the empty marker that their writer leaves.

    The checksum files that a local file system keeps beside each are left out.
    """
    folder = shared_folder(spark, "files")
    rows = _filed(spark, d).repartition("source", "part").sortWithinPartitions("source", "part", "doc_id")
    write_lines(rows.select("source", "part", "text"), folder)
    found = file_inventory(spark, folder).where(~F.col("path").rlike(r"(^|/)\.[^/]*\.crc$"))
    return found.select(F.regexp_replace("path", "/part-[^/]*$", "").alias("path"), "byte_length", "line_count", "sha256")


def line_offsets(spark, d):
    """Whole texts as lines, keyed by file and byte offset; long ones have no payload."""
    folder = shared_folder(spark, "lines")
    line = F.translate("text", "\r\n", "  ")
    _filed(spark, d).repartition("source").sortWithinPartitions("source", "doc_id").select("source", line.alias("value")).write.partitionBy("source").text(folder)
    written = walk_files(spark, folder).where(F.col("path").rlike("/part-[^/]*$"))
    lines = read_lines(spark, folder, 2000, split_bytes=50_000, files=written)
    return lines.select(F.regexp_replace("path", "/part-[^/]*$", "").alias("path"), "offset", "size", F.md5("payload").alias("payload_md5"))


def manifest_rows(spark, d):
    """Manifests written as JSON documents, one a folder, and read together."""
    folder = shared_folder(spark, "manifests")
    identity = F.struct(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("byte_length"),
        F.lit("100644").alias("git_mode"), F.sha2("text", 256).alias("sha256"))
    documents = _filed(spark, d).groupBy("source", "part").agg(F.collect_list(identity).alias("files")).select(
        "source", "part", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("files").alias("kind"), "files")).alias("value"))
    write_lines(documents, folder)
    return read_manifest(spark, folder).select("path", "byte_length", "git_mode", "sha256")


def manifest_codes(spark, d):
    """A manifest for each document, most of them damaged in one way."""
    n = F.col("doc_id") % 16
    digest = F.when(n == 1, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256))
    entry = F.concat(
        F.lit('{"path":"doc/'), F.col("doc_id").cast("string"), F.when(n == 2, '","path":"x').otherwise(""), F.lit('","byte_length":'),
        F.when(n == 3, F.lit("-1")).when(n == 4, F.lit("1.5")).when(n == 5, F.lit('"7"')).otherwise(F.octet_length("text").cast("string")),
        F.lit(',"git_mode":"'), F.when(n == 6, "120000").otherwise("100644"), F.lit('","sha256":"'), digest, F.lit('"'),
        F.when(n == 7, ',"owner":1').otherwise(""), F.lit("}"))
    document = F.concat(
        F.lit('{"schema_version":'), F.when(n == 8, "2").otherwise("1"), F.when(n == 9, ',"kind":7').when(n == 10, "").otherwise(',"kind":"files"'),
        F.lit(',"files":'), F.when(n == 11, "null").when(n == 12, "[3]").when(n == 13, F.concat(F.lit("["), entry, F.lit(","), entry, F.lit("]")))
        .otherwise(F.concat(F.lit("["), entry, F.lit("]"))), F.when(n == 14, "").otherwise("}"))
    raw = _documents(spark, d).select(
        F.col("doc_id").cast("string").alias("record_key"), document.cast("binary").alias("payload"), (n == 15).alias("oversize"))
    coded = decode_manifests(raw, "files")
    return coded.select(
        F.col("record_key").cast("long").alias("doc_id"), "error_code",
        F.when(F.col("error_code").isNull(), F.get("files", F.lit(0))["sha256"]).alias("sha256"))


# --- sweeps -----------------------------------------------------------------------------


def _sweep(spark, d):
    return G.truncation_sweep(_pairs(spark, d), TOKENIZER, SWEEP)


def truncation_sweep(spark, d):
    """All 19 columns; the fixtures are those of pairs whose conversation has an even number."""
    pairs = _pairs(spark, d).where("conv_id % 2 = 0").select(
        "case_id", F.concat(F.lit("cases/"), "case_id").alias("base_fixture_path"), F.sha2(F.concat("source", "target"), 256).alias("fixture_raw_sha256"))
    return _flat(G.sweep_table(_sweep(spark, d), *IDENTITY, pairs))


def sweep_input_digests(spark, d):
    return _flat(G.sweep_table(_sweep(spark, d), *IDENTITY).select("case_id", "max_length", "canonical_input_sha256"))


def retention_matrix(spark, d):
    wide = G.retention_matrix(_sweep(spark, d), SWEEP)
    return wide.select("case_id", *[F.col(str(n)).alias(f"len_{n}") for n in SWEEP])


def input_matrix(spark, d):
    sources = _turns(spark, d).where(F.col("role") == "user").select(
        F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("case_id"),
        F.col("text").alias("source"))
    return G.input_matrix_counts(G.input_matrix(sources, PROBES), TOKENIZER, (32, 128))


def all_lengths_sweep(spark, d):
    """Every length from 2 to 512, from intervals: cells and sums by length and class."""
    rows = G.expand_intervals(G.sweep_intervals(_pairs(spark, d), TOKENIZER))
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return rows.groupBy(F.col("max_length").cast("bigint").alias("max_length"), "primary_classification").agg(
        F.count(F.lit(1)).alias("cells"), total("legacy_cutoff"), total("oracle_cutoff"), total("retained_target_tokens"), total("supervised_target_tokens"),
        total("truncated_target_tokens"), F.sum(F.length("prompt_leakage_positions")).alias("leak_letters"))


def sweep_lookups(spark, d):
    """A length of its own for every pair, looked up in the intervals."""
    pairs = _pairs(spark, d)
    wanted = pairs.select("case_id", (2 + F.pmod(F.col("conv_id") * 37 + F.col("turn") * 11, F.lit(511))).cast("int").alias("max_length"))
    return _flat(G.at_lengths(G.sweep_intervals(pairs, TOKENIZER), wanted).select(
        "case_id", "max_length", "exit_code", "status", "primary_classification", "legacy_cutoff", "oracle_cutoff", "full_target_tokens",
        "retained_target_tokens", "supervised_target_tokens", "prompt_leakage_positions", "cross_boundary_positions", "elimination_causes", "indeterminate_reasons"))


def turn_matrix(spark, d):
    """Every user turn against every assistant turn, counted by classes without their pairs."""
    turns = _turns(spark, d)
    side = lambda role, name: turns.where((F.col("role") == role) & F.col("text").isNotNull()).select(F.col("text").alias(name))
    return M.matrix_counts(side("user", "source"), side("assistant", "target"), TOKENIZER, (32, 128))


QUERIES = (
    sft_prompts, concatenated_pairs, case_identities, case_codes,
    message_codes, content_limits, conversation_codes, turn_order_codes, quarantine_counts, redacted_rejects,
    long_conversation_codes, long_turn_orders, gapped_reply_pairs, gated_traces,
    trace_exit_codes, trace_codes, trace_part_codes, trace_document_codes, case_document_codes,
    trace_summaries, padding_starts, eligible_positions, boundary_positions, token_category_counts, built_labels,
    label_codes, label_counts, supervised_positions, supervised_runs, token_runs, token_categories, label_digests, empty_targets,
    audit_invariants, supplied_label_audit, unmatched_labels, trace_audit_rollup, trace_audit_reports, trace_digests, injected_faults, policy_comparison,
    token_lengths, masked_examples, padded_batches, dataset_order_batches, mapped_batches, attention_masks, sampled_examples,
    nfc_documents, stripped_documents, document_pieces, normalization_snapshots, encodings, token_ownership,
    nonprefix_ownership, boundary_reasons, boundary_diagnostics, boundary_classes, mask_positions, unicode_boundary_classes, report_digests,
    report_violations, report_violation_rows, file_drift, file_identities, bound_identity, artifact_manifest,
    bound_paths, unread_manifest, golden_nulls, stored_golden_drift, unexpected_results, semantic_props, golden_drift, expectation_mismatches,
    sft_rows, trace_lines, case_lines, stored_reports, stored_sweep, scanned_files, line_offsets, manifest_rows, manifest_codes,
    truncation_sweep, sweep_input_digests, retention_matrix, input_matrix, all_lengths_sweep, sweep_lookups, turn_matrix,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(ship_package(spark), sf_dir)

        return run

    return {query.__name__: shipped(query) for query in QUERIES}
