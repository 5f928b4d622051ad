"""Declared schemas and the fixed values shared by every operator."""

from pyspark.sql import types as T

# --- fixed values: contract enumerations and limits -------------------------
ROLES = ("system", "user", "assistant")
TRACE_KIND = "loss-topology.synthetic-pretokenized-trace"
TRACE_SCHEMA_VERSION = 1
CASE_SCHEMA_VERSION = "token-boundary-synthetic-case-v1"
ID_PATTERN = r"\A[a-z0-9][a-z0-9._-]{0,63}\z"

TRACE_MAX_BYTES = 128 * 1024
TRACE_MAX_DEPTH = 8
TRACE_MAX_NODES = 20_000
MAX_INT32 = 2_147_483_647
MAX_MESSAGES = 64
MAX_MESSAGE_BYTES = 8 * 1024
MAX_CONTENT_BYTES = 64 * 1024
MAX_TOKENS = 4_096
MAX_SEGMENTS = 195

CASE_MAX_BYTES = 32 * 1024
CASE_MAX_DEPTH = 4
CASE_MAX_NODES = 64
CASE_INT_DIGITS = 6
MAX_TEXT_BYTES = 8 * 1024
MIN_MODEL_LENGTH = 2
MAX_MODEL_LENGTH = 512

BOUNDARY_KINDS = ("prefix_special", "message_start", "message_end", "suffix_special")
IGNORE_INDEX = -100
ALL_TOKENS = "all_tokens"
ASSISTANT_ONLY = "assistant_only"
POLICIES = (ALL_TOKENS, ASSISTANT_ONLY)

OWNERSHIPS = ("injected_prefix", "source", "target", "cross_boundary", "ambiguous")
CLASSIFICATIONS = (
    "indeterminate",
    "cross_boundary_token",
    "target_eliminated",
    "partial_target_truncation",
    "boundary_drift",
    "aligned",
)
STATUSES = ("pass", "fail", "indeterminate")
ELIMINATION_CAUSES = ("truncation", "legacy_cutoff")
INDETERMINATE_REASONS = (
    "encoding.offset_provenance",
    "encoding.piece_alignment",
    "encoding.unknown_token",
    "normalization.cluster_replay",
    "normalization.provenance_ambiguous",
    "normalization.runtime_mismatch",
    "target.no_attributable_token",
    "truncation.not_exact_prefix",
)
MASK_ALGORITHM = "standalone-source-token-count"

TRACE_ERROR_CODES = (
    "input.byte_limit", "input.utf8",
    "json.invalid", "json.duplicate_key", "json.integer_out_of_range",
    "json.floating_point_forbidden", "json.non_finite_number",
    "json.node_limit", "json.depth_limit",
    "root.type", "root.fields", "schema.version", "schema.kind", "example_id",
    "conversation.type", "conversation.fields", "messages.type", "messages.count",
    "message.type", "message.fields", "message.role", "message.content_type",
    "message.content_nul", "message.content_unicode", "message.content_limit",
    "messages.content_limit", "messages.turn_order",
    "trace.type", "trace.fields", "token_ids.type", "token_ids.count", "token_ids.item",
    "padding_token_id", "segments.type", "segments.count",
    "segment.type", "segment.fields", "segment.kind", "segment.message_index",
    "segment.start", "segment.end",
    "segments.sequence", "segments.coverage", "segments.range", "segments.boundary_empty",
    "trace.non_padding_empty", "trace.padding_mismatch",
)
CASE_ERROR_CODES = (
    "document.size", "document.utf8", "document.json", "document.nodes", "document.depth",
    "document.root", "document.fields", "schema_version", "case_id",
    "text.value", "text.size", "text.unicode", "max_length.type", "max_length.range",
)
# --- end of fixed values ----------------------------------------------------

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
SEGMENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("message_index", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
TRACE_BODY = T.StructType([
    T.StructField("token_ids", T.ArrayType(T.IntegerType())),
    T.StructField("padding_token_id", T.IntegerType()),
    T.StructField("segments", T.ArrayType(SEGMENT)),
])
TRACES = T.StructType([
    T.StructField("example_id", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("trace", TRACE_BODY),
])
CASES = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("max_length", T.IntegerType()),
])
ENCODING = T.StructType([
    T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("offsets", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("pieces", T.ArrayType(T.StringType())),
    T.StructField("special_tokens_mask", T.ArrayType(T.IntegerType())),
    T.StructField("type_ids", T.ArrayType(T.IntegerType())),
])
SFT_ROWS = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("output", T.StringType()),
])
MANIFEST_SCHEMA_VERSION = 1
MANIFEST_MAX_BYTES = 64 << 20
GIT_MODES = ("100644", "100755")
MANIFEST_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("byte_length", T.LongType()),
    T.StructField("line_count", T.LongType()),
    T.StructField("git_mode", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("git_blob_sha1", T.StringType()),
])
MANIFEST = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("files", T.ArrayType(MANIFEST_FILE)),
])
