"""JSON documents in, typed rows and redacted rejects out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.arrays import first_code, let
from labelscope.functions.strict_json import CASE_RULES, MANIFEST_RULES, TRACE_RULES, JsonRules, size_code, strict_json
from labelscope.operators import contract as V
from labelscope.sources.files import SPLIT_BYTES, read_lines
from labelscope.sources.tables import scan_files

TRACE_FIELDS = ("conversation", "example_id", "kind", "schema_version", "trace")
CASE_FIELDS = ("case_id", "max_length", "schema_version", "source", "target")


def line_key(value: Column) -> Column:
    """File and content of one line; equal lines of a file share it."""
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.md5(value))


def numbered(key: Column) -> Column:
    """``key`` with a running number, so that no two rows share it."""
    return F.concat(key, F.lit("#"), F.monotonically_increasing_id().cast("string"))


def read_raw(
    spark: SparkSession, path: str, layout: str, max_bytes: int, listing: DataFrame | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``record_key, payload, oversize`` from one-document files or from JSON lines.

    Every listed file is a row. Oversize files and hidden ones (which no scan
    reads) have no payload; an empty file has an empty one. ``offsets`` are lines
    keyed by file and byte offset, the same however files are split; hidden files
    are read, and oversize lines never held.
    """
    if layout == "offsets":
        lines = read_lines(spark, path, max_bytes, split_bytes, listing)
        return lines.select(
            F.concat("path", F.lit("#"), F.col("offset").cast("string")).alias("record_key"), "payload", (F.col("size") > max_bytes).alias("oversize"))
    if layout == "lines":
        return spark.read.text(path).select(
            numbered(line_key(F.col("value"))).alias("record_key"), F.col("value").cast("binary").alias("payload"), F.lit(False).alias("oversize"))
    files = scan_files(spark, path, max_bytes, listing)
    return files.select(
        F.col("path").alias("record_key"), F.col("content").alias("payload"), (F.col("bytes") > max_bytes).alias("oversize"))


# --- variant helpers ----------------------------------------------------------


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _has_fields(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_sort(F.map_keys(_object(value))) == F.array(*map(F.lit, sorted(names)))


def _typed(value: Column, kind: str, sql_type: str) -> Column:
    """The value when it has exactly this JSON type, else NULL."""
    return F.when(F.schema_of_variant(value) == kind, F.try_variant_get(value, "$", sql_type))


def _string(value: Column) -> Column:
    return _typed(value, "STRING", "string")


def _int(value: Column) -> Column:
    return _typed(value, "BIGINT", "int")


def _shape(value: Column, kind: str, names: tuple[str, ...]) -> Column:
    return F.when(_object(value).isNull(), f"{kind}.type").when(~_has_fields(value, names), f"{kind}.fields")


# --- traces -------------------------------------------------------------------


def _message(value: Column, index: Column, lone: Column) -> Column:
    role, content = _string(_field(value, "role")), _string(_field(value, "content"))
    own = V.message_code(role, content)
    unpaired = F.array_contains(lone, index)
    code = F.coalesce(
        _shape(value, "message", ("role", "content")),
        F.when(unpaired & (own.isNull() | (own == "message.content_limit")), "message.content_unicode").otherwise(own))
    return F.struct(
        role.alias("role"), content.alias("content"), F.octet_length(content).alias("bytes"), code.alias("code"))


def _segment_code(value: Column) -> Column:
    index = _field(value, "message_index")
    bad = lambda v, top: ~F.coalesce(v.between(0, top), F.lit(False))
    return F.coalesce(
        _shape(value, "segment", ("kind", "message_index", "start", "end")),
        F.when(_string(_field(value, "kind")).isNull(), "segment.kind"),
        F.when(~F.is_variant_null(index) & bad(_int(index), S.MAX_MESSAGES - 1), "segment.message_index"),
        F.when(bad(_int(_field(value, "start")), S.MAX_TOKENS), "segment.start"),
        F.when(bad(_int(_field(value, "end")), S.MAX_TOKENS), "segment.end"),
    )


def _segment(value: Column) -> Column:
    return F.struct(
        _string(_field(value, "kind")).alias("kind"), _int(_field(value, "message_index")).alias("message_index"),
        _int(_field(value, "start")).alias("start"), _int(_field(value, "end")).alias("end"))


def _decoded(raw: DataFrame, rules: JsonRules) -> DataFrame:
    """Adds ``root`` (variant), ``decode_code`` and ``lone``."""
    out = raw.withColumn("_decoded", strict_json(F.col("payload"), rules))
    size = (F.when(F.col("oversize"), rules.codes["size"]).when(F.col("payload").isNull(), "internal.error")
            .otherwise(size_code(F.col("payload"), rules)))
    return out.select(
        "record_key",
        F.coalesce(size, F.col("_decoded.code")).alias("decode_code"),
        F.coalesce(F.col("_decoded.lone"), F.array().cast("array<int>")).alias("lone"),
        F.try_parse_json(F.coalesce(F.col("_decoded.clean"), F.col("payload").cast("string"))).alias("root"),
    )


def decode_traces(raw: DataFrame) -> DataFrame:
    """``record_key, example_id, messages, trace, error_code`` of raw documents."""
    rows = _decoded(raw, TRACE_RULES).select(
        "record_key", "decode_code", "lone", "root",
        *[_field(F.col("root"), name).alias(name) for name in TRACE_FIELDS])
    root_code = _shape(F.col("root"), "root", TRACE_FIELDS)
    rows = rows.select(
        "record_key", "decode_code", root_code.alias("root_code"), "conversation", "trace",
        F.when(~F.coalesce(_int(F.col("schema_version")) == S.TRACE_SCHEMA_VERSION, F.lit(False)), "schema.version")
        .when(~F.coalesce(_string(F.col("kind")) == S.TRACE_KIND, F.lit(False)), "schema.kind").alias("head_code"),
        _string(F.col("example_id")).alias("example_id"),
        _array(_field(F.col("conversation"), "messages")).alias("_messages"), "lone",
        _array(_field(F.col("trace"), "token_ids")).alias("_ids"),
        _array(_field(F.col("trace"), "segments")).alias("_segments"),
        _int(_field(F.col("trace"), "padding_token_id")).alias("_pad"),
    )
    rows = rows.select(
        "record_key", "decode_code", "root_code", "head_code", "example_id",
        _shape(F.col("conversation"), "conversation", ("messages",)).alias("conversation_code"),
        let(F.col("lone"), lambda l: F.transform("_messages", lambda m, i: _message(m, i, l))).alias("_messages"),
        _shape(F.col("trace"), "trace", ("token_ids", "padding_token_id", "segments")).alias("body_code"),
        F.struct(
            F.transform("_ids", _int).alias("token_ids"), F.col("_pad").alias("padding_token_id"),
            F.transform("_segments", _segment).alias("segments"),
        ).alias("trace"),
        first_code(F.transform("_segments", _segment_code)).alias("segment_code"),
    )
    count = F.size("_messages")
    code = F.coalesce(
        "decode_code", "root_code", "head_code", V.example_id_code(F.col("example_id")), "conversation_code",
        V.conversation_code(F.col("_messages")), "body_code", V.token_code(F.col("trace")),
        V.segment_count_code(F.col("trace.segments"), count), "segment_code",
        V.segment_layout_code(F.col("trace.segments"), F.size("trace.token_ids")), V.padding_code(F.col("trace")))
    plain = F.transform("_messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select("record_key", "example_id", plain.alias("messages"), "trace", code.alias("error_code"))


def read_traces(
    spark: SparkSession, path: str, layout: str = "files", listing: DataFrame | None = None, split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Valid traces (``schemas.TRACES``) and ``record_key, error_code`` rejects."""
    coded = decode_traces(read_raw(spark, path, layout, S.TRACE_MAX_BYTES, listing, split_bytes))
    valid, rejects = V.quarantine_split(coded, "record_key")
    return valid.drop("record_key"), rejects


# --- cases --------------------------------------------------------------------


def decode_cases(raw: DataFrame) -> DataFrame:
    """``record_key, case_id, source, target, max_length, error_code``."""
    rows = _decoded(raw, CASE_RULES).select(
        "record_key", "decode_code", "lone",
        F.when(_object(F.col("root")).isNull(), "document.root")
        .when(~_has_fields(F.col("root"), CASE_FIELDS), "document.fields").alias("root_code"),
        _string(_field(F.col("root"), "schema_version")).alias("version"),
        _string(_field(F.col("root"), "case_id")).alias("case_id"),
        _string(_field(F.col("root"), "source")).alias("source"),
        _string(_field(F.col("root"), "target")).alias("target"),
        _int(_field(F.col("root"), "max_length")).alias("max_length"),
    )
    code = F.coalesce(
        "decode_code", "root_code",
        F.when(~F.coalesce(F.col("version") == S.CASE_SCHEMA_VERSION, F.lit(False)), "schema_version"),
        V.case_code(
            F.col("case_id"), F.when(~F.array_contains("lone", 0), F.col("source")),
            F.when(~F.array_contains("lone", 1), F.col("target")), F.col("max_length")))
    return rows.select("record_key", "case_id", "source", "target", "max_length", code.alias("error_code"))


def read_cases(
    spark: SparkSession, path: str, layout: str = "files", listing: DataFrame | None = None, split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Valid cases (``schemas.CASES``) and ``record_key, error_code`` rejects."""
    coded = decode_cases(read_raw(spark, path, layout, S.CASE_MAX_BYTES, listing, split_bytes))
    valid, rejects = V.quarantine_split(coded, "record_key")
    return valid.drop("record_key"), rejects


# --- manifests ----------------------------------------------------------------

MANIFEST_FIELDS = ("files", "kind", "schema_version")
_FILE_FIELDS = tuple(S.MANIFEST_FILE.fieldNames())


def _file(value: Column) -> Column:
    kinds = {"byte_length": "BIGINT", "line_count": "BIGINT"}
    typed = lambda f: _typed(_field(value, f), kinds.get(f, "STRING"), "bigint" if f in kinds else "string")
    return F.struct(*[typed(f).alias(f) for f in _FILE_FIELDS])


def _file_code(value: Column) -> Column:
    """The first rule that an entry breaks; a field may be absent, ``path`` and ``sha256`` not."""
    entry = _object(value)
    known = F.size(F.array_except(F.map_keys(entry), F.array(*map(F.lit, _FILE_FIELDS)))) == 0
    named = F.array_contains(F.map_keys(entry), "path") & F.array_contains(F.map_keys(entry), "sha256")
    rules = {
        "path": lambda v: F.length(v) > 0, "byte_length": lambda v: v >= 0, "line_count": lambda v: v >= 0,
        "git_mode": lambda v: v.isin(*S.GIT_MODES), "sha256": lambda v: v.rlike(r"\A[0-9a-f]{64}\z"), "git_blob_sha1": lambda v: v.rlike(r"\A[0-9a-f]{40}\z"),
    }
    return let(_file(value), lambda f: F.coalesce(
        F.when(entry.isNull(), "manifest.file.type").when(~(known & named), "manifest.file.fields"),
        *[F.when(F.array_contains(F.map_keys(entry), n) & ~F.coalesce(rule(f[n]), F.lit(False)), f"manifest.file.{n}") for n, rule in rules.items()]))


def decode_manifests(raw: DataFrame, kind: str | None = None) -> DataFrame:
    """``record_key, files, error_code`` of raw manifests; the first rule broken has the say."""
    root = F.col("root")
    rows = _decoded(raw, MANIFEST_RULES).select(
        "record_key", "decode_code",
        F.when(_object(root).isNull(), "manifest.root").when(~_has_fields(root, MANIFEST_FIELDS), "manifest.fields").alias("root_code"),
        _int(_field(root, "schema_version")).alias("version"), _string(_field(root, "kind")).alias("kind"), _array(_field(root, "files")).alias("_files"))
    told = F.col("kind").isNotNull() if kind is None else F.col("kind") == kind
    rows = rows.withColumn("files", F.transform("_files", _file))
    paths = F.transform("files", lambda f: f["path"])
    code = F.coalesce(
        "decode_code", "root_code",
        F.when(~F.coalesce(F.col("version") == S.MANIFEST_SCHEMA_VERSION, F.lit(False)), "manifest.version"),
        F.when(~F.coalesce(told, F.lit(False)), "manifest.kind"), F.when(F.col("_files").isNull(), "manifest.files"),
        first_code(F.transform("_files", _file_code)),
        F.when(F.size(F.array_distinct(paths)) < F.size(paths), "manifest.file.duplicate"))
    return rows.select("record_key", "files", code.alias("error_code"))


def read_manifests(
    spark: SparkSession, path: str, layout: str = "files", kind: str | None = None, listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``record_key`` and one row per listed file of the manifests that meet the contract, and ``record_key, error_code`` rejects."""
    coded = decode_manifests(read_raw(spark, path, layout, S.MANIFEST_MAX_BYTES, listing), kind)
    valid, rejects = V.quarantine_split(coded, "record_key")
    return valid.select("record_key", F.explode("files").alias("f")).select("record_key", "f.*"), rejects
