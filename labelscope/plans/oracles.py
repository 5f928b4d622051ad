"""DuckDB SQL that recomputes the registered queries relationally.

Traces and encodings are built one token per row here, where the Spark side works
on arrays, so the two share no formulation.
"""

_CODED = """
coded AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
    CASE WHEN role IS NULL OR role NOT IN ('system','user','assistant') THEN 'message.role'
         WHEN text IS NULL THEN 'message.content_type'
         WHEN contains(text, chr(0)) THEN 'message.content_nul'
         WHEN strlen(text) > 8192 THEN 'message.content_limit' END AS own,
    sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS running
  FROM {turns}),
flags AS (
  SELECT conv_id, count(*) AS n, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys,
    arg_min(coalesce(own, CASE WHEN running > 65536 THEN 'messages.content_limit' END), i)
      FILTER (own IS NOT NULL OR running > 65536) AS bad
  FROM coded GROUP BY conv_id),
orders AS (
  SELECT c.conv_id, bool_and(CASE WHEN i = 0 AND role = 'system' THEN true
      ELSE role = CASE WHEN (i - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END END)
    AND max(n) > max(sys) AND max(CASE WHEN i = n - 1 THEN role END) = 'assistant' AS ok
  FROM coded c JOIN flags USING (conv_id) GROUP BY c.conv_id),
codes AS (
  SELECT conv_id, CASE WHEN n > 64 THEN 'messages.count' WHEN bad IS NOT NULL THEN bad
    WHEN NOT ok THEN 'messages.turn_order' END AS error_code
  FROM flags JOIN orders USING (conv_id))"""

_TOKENS = """,
sound AS (SELECT conv_id, 'conv-' || conv_id AS example_id FROM codes WHERE error_code IS NULL),
sound_msg AS (
  SELECT c.conv_id, v.example_id, c.i, c.role, c.text, regexp_extract_all(c.text, '[^ \\n\\t\\r]+') AS w
  FROM coded c JOIN sound v USING (conv_id)),
valid AS (
  SELECT conv_id, example_id FROM sound_msg GROUP BY ALL HAVING ((2 + sum(2 + len(w)) + 7) // 8) * 8 <= 4096),
msg AS (SELECT m.* FROM sound_msg m JOIN valid USING (conv_id)),
cells AS (
  SELECT example_id, -1 AS i, 0 AS k, 1 AS token, 'boundary' AS cat FROM valid
  UNION ALL SELECT example_id, i, 0, CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 20 ELSE 30 END, 'boundary' FROM msg
  UNION ALL SELECT example_id, i, u.k, ('0x' || substr(md5(w[u.k]), 1, 7))::INT, role
    FROM msg, unnest(range(1, len(w) + 1)) AS u(k)
  UNION ALL SELECT example_id, i, len(w) + 1, 12, 'boundary' FROM msg
  UNION ALL SELECT example_id, 1000, 0, 2, 'boundary' FROM valid),
body AS (SELECT example_id, i, k, row_number() OVER (PARTITION BY example_id ORDER BY i, k) - 1 AS pos, token, cat FROM cells),
sizes AS (SELECT example_id, count(*) AS used, ((count(*) + 7) // 8) * 8 AS total FROM body GROUP BY 1),
tok AS (
  SELECT example_id, pos, token, cat FROM body
  UNION ALL SELECT example_id, used + p, 0, 'padding' FROM sizes, unnest(range(0, total - used)) AS r(p)),
lab AS (
  SELECT example_id, policy, pos, token, cat,
    CASE WHEN policy = 'all_tokens' THEN cat <> 'padding' ELSE cat = 'assistant' END AS eligible
  FROM tok, (VALUES ('all_tokens'), ('assistant_only')) AS p(policy)),
labels_t AS (SELECT *, CASE WHEN eligible THEN token ELSE -100 END AS label FROM lab)"""

_SEGMENTS = """,
message_spans AS (
  SELECT example_id, i, min(pos) AS s, max(pos) + 1 AS e FROM body WHERE i BETWEEN 0 AND 999 GROUP BY 1, 2)"""

_PAIRS = """
pairs AS (
  SELECT conv_id, turn, 'pair-' || conv_id || '-' || turn AS case_id, text AS source, next_text AS target
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM {turns}
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
  WHERE role = 'user' AND next_role = 'assistant' AND text IS NOT NULL AND next_text IS NOT NULL)"""

_PATTERN = "(?s)the|th|ing|in|er|."
_ID = ("CASE {p} WHEN 'th' THEN 2 WHEN 'the' THEN 3 WHEN 'in' THEN 4 WHEN 'ing' THEN 5 WHEN 'er' THEN 6 "
       "ELSE 1024 + unicode({p}) END")

_ENCODED = f""",
enc AS (
  SELECT *, length(source) AS b,
    regexp_extract_all(regexp_replace(source, '\\s+$', ''), '{_PATTERN}') AS sp,
    regexp_extract_all(regexp_replace(source || target, '\\s+$', ''), '{_PATTERN}') AS cp
  FROM pairs)"""

_OWNED = """,
piece AS (SELECT case_id, b, u.k AS pos, cp[u.k] AS p FROM enc, unnest(range(1, len(cp) + 1)) AS u(k)),
placed AS (SELECT *, sum(length(p)) OVER (PARTITION BY case_id ORDER BY pos) AS e FROM piece),
owned AS (
  SELECT case_id, pos, p, e - length(p) AS s, e,
    CASE WHEN e <= b THEN 'source' WHEN e - length(p) >= b THEN 'target' ELSE 'cross_boundary' END AS owner
  FROM placed)"""

_CUT = """,
cut AS (
  SELECT case_id, max_length, least(len(sp) + 1, max_length) AS cutoff, least(len(cp) + 1, max_length) AS kept
  FROM enc, unnest([{lengths}]) AS l(max_length)),
facts AS (
  SELECT c.case_id, c.max_length, c.cutoff, c.kept,
    string_agg(CASE WHEN owner = 'source' AND pos < kept AND pos >= cutoff THEN pos END, '|' ORDER BY pos) AS leak,
    string_agg(CASE WHEN owner = 'target' AND pos < kept AND pos < cutoff THEN pos END, '|' ORDER BY pos) AS hidden,
    string_agg(CASE WHEN owner = 'cross_boundary' THEN pos END, '|' ORDER BY pos) AS crossing,
    min(CASE WHEN owner = 'target' AND pos < kept THEN pos END) AS oracle,
    count(*) FILTER (owner = 'target') AS full_n,
    count(*) FILTER (owner = 'target' AND pos < kept) AS kept_n,
    count(*) FILTER (owner = 'target' AND pos < kept AND pos >= cutoff) AS shown_n
  FROM cut c JOIN owned o USING (case_id) GROUP BY ALL),
classed AS (
  SELECT *, full_n > 0 AND shown_n = 0 AS gone, 0 < kept_n AND kept_n < full_n AS partly,
    leak IS NOT NULL OR hidden IS NOT NULL OR coalesce(oracle <> cutoff, false) AS drift,
    full_n = 0 AND crossing IS NULL AS absent
  FROM facts),
named AS (
  SELECT *, concat_ws('|', CASE WHEN absent THEN 'indeterminate' END,
      CASE WHEN crossing IS NOT NULL THEN 'cross_boundary_token' END,
      CASE WHEN gone THEN 'target_eliminated' END, CASE WHEN partly THEN 'partial_target_truncation' END,
      CASE WHEN drift THEN 'boundary_drift' END) AS raw
  FROM classed),
reports AS (
  SELECT *, CASE WHEN raw = '' THEN 'aligned' ELSE raw END AS classes,
    split_part(CASE WHEN raw = '' THEN 'aligned' ELSE raw END, '|', 1) AS prim,
    CASE split_part(CASE WHEN raw = '' THEN 'aligned' ELSE raw END, '|', 1)
      WHEN 'indeterminate' THEN 'indeterminate' WHEN 'aligned' THEN 'pass' ELSE 'fail' END AS stat,
    CASE WHEN gone THEN concat_ws('|', CASE WHEN kept_n < full_n THEN 'truncation' END,
      CASE WHEN kept_n > 0 THEN 'legacy_cutoff' END) ELSE '' END AS causes,
    CASE WHEN absent THEN 'target.no_attributable_token' ELSE '' END AS reasons
  FROM named)"""

_WS = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}]"


def _encoding_json(n: str, ids: str, offsets: str, pieces: str) -> str:
    return (f"'{{\"attention_mask\":[' || repeat('1,', coalesce({n}, 0)::INT) || '1],\"ids\":[' || concat_ws(',', '1', {ids}) || "
            f"'],\"offsets\":[' || concat_ws(',', '[0,0]', {offsets}) || '],\"pieces\":[' || concat_ws(',', '\"<bos>\"', {pieces}) || "
            f"'],\"special_tokens_mask\":[1' || repeat(',0', coalesce({n}, 0)::INT) || '],\"type_ids\":[' || repeat('0,', coalesce({n}, 0)::INT) || '0]}}'")


def _names(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN '[]' ELSE '[\"' || replace({text}, '|', '\",\"') || '\"]' END"


def _numbers(text: str) -> str:
    return f"'[' || replace(coalesce({text}, ''), '|', ',') || ']'"


def _norm(raw: str, cut: str) -> str:
    return (f"'{{\"cross_boundary_output_positions\":[],\"nfc_codepoint_count\":' || length({raw}) || ',\"normalized_codepoint_count\":' || length({cut}) || "
            f"',\"provenance_complete\":true,\"raw_codepoint_count\":' || length({raw}) || ',\"trailing_normalized_codepoints_removed\":' || (length({raw}) - length({cut})) || '}}'")


_CELL = ("string_agg(id, ',' ORDER BY pos) AS ids, string_agg('[' || s || ',' || e || ']', ',' ORDER BY pos) AS offsets, "
         "string_agg(pj, ',' ORDER BY pos) AS pieces, count(*) AS n")
_OWNER_JSON = "string_agg(',{\"ownership\":\"' || owner || '\",\"position\":' || pos || ',\"raw_origins\":[' || array_to_string(range(s::BIGINT, e::BIGINT), ',') || ']}', '' ORDER BY pos) AS owners"
_PREFIX_JSON = "'[{\"ownership\":\"injected_prefix\",\"position\":0,\"raw_origins\":[]}' || coalesce({x}, '') || ']'"


def _digests() -> str:
    """The canonical report of every row of ``reports``, put together piece by piece, and its hash."""
    piece = "CASE WHEN unicode(p) > 127 THEN '\"\\u' || lpad(lower(to_hex(unicode(p))), 4, '0') || '\"' ELSE to_json(p)::VARCHAR END AS pj"
    token = _ID.format(p="p") + " AS id"
    strip = "regexp_replace({x}, '\\s+$', '')"
    return f""",
combined_cells AS (SELECT case_id, pos, s, e, owner, {piece}, {token} FROM owned),
source_cells AS (
  SELECT case_id, pos, e - length(p) AS s, e, {piece}, {token} FROM (
    SELECT *, sum(length(p)) OVER (PARTITION BY case_id ORDER BY pos) AS e FROM (
      SELECT case_id, u.k AS pos, sp[u.k] AS p FROM enc, unnest(range(1, len(sp) + 1)) AS u(k)))),
whole AS (SELECT case_id, {_CELL}, {_OWNER_JSON} FROM combined_cells GROUP BY case_id),
limited AS (
  SELECT case_id, max_length, {_CELL}, {_OWNER_JSON} FROM combined_cells JOIN (SELECT case_id, max_length FROM reports) USING (case_id)
  WHERE pos < max_length GROUP BY case_id, max_length),
source_limited AS (
  SELECT case_id, max_length, {_CELL} FROM source_cells JOIN (SELECT case_id, max_length FROM reports) USING (case_id)
  WHERE pos < max_length GROUP BY case_id, max_length),
digested AS (
  SELECT r.*, sha256('{{"artifact_identity":{{"tokenizer":"open-text"}},"attribution":{{"full":' || {_PREFIX_JSON.replace('{x}', 'w.owners')} ||
    ',"truncated":' || {_PREFIX_JSON.replace('{x}', 'l.owners')} || '}},"classifications":' || {_names('classes')} ||
    ',"diagnostics":{{"ambiguous_positions":[],"cross_boundary_positions":' || {_numbers('crossing')} || ',"elimination_causes":' || {_names('causes')} ||
    ',"full_target_token_count":' || full_n || ',"indeterminate_reasons":' || {_names('reasons')} || ',"masked_retained_target_positions":' || {_numbers('hidden')} ||
    ',"oracle_cutoff":' || coalesce(oracle::VARCHAR, 'null') || ',"prompt_leakage_positions":' || {_numbers('leak')} ||
    ',"retained_target_token_count":' || kept_n || ',"supervised_target_token_count":' || shown_n || ',"truncated_target_token_count":' || (full_n - kept_n) ||
    '}},"encodings":{{"combined_full":' || {_encoding_json('w.n', 'w.ids', 'w.offsets', 'w.pieces')} || ',"combined_truncated":' || {_encoding_json('l.n', 'l.ids', 'l.offsets', 'l.pieces')} ||
    ',"source_truncated":' || {_encoding_json('s.n', 's.ids', 's.offsets', 's.pieces')} || '}},"input_identity":{{"boundary_codepoint":' || length(source) ||
    ',"canonical_sha256":"' || {_case_sha('max_length')} || '","case_id":"' || case_id || '","max_length":' || max_length || ',"source_codepoints":' || length(source) ||
    ',"target_codepoints":' || length(target) || '}},"kind":"token-boundary.differential-report","legacy_mask":{{"algorithm":"standalone-source-token-count","cutoff":' || cutoff ||
    ',"masked_positions":[' || array_to_string(range(0, least(cutoff, kept)), ',') || '],"supervised_positions":[' || array_to_string(range(least(cutoff, kept), kept), ',') ||
    ']}},"normalization":{{"combined":' || {_norm('(source || target)', strip.format(x='(source || target)'))} || ',"source":' || {_norm('source', strip.format(x='source'))} ||
    '}},"primary_classification":"' || prim || '","schema_version":"token-boundary-differential-report-v1","scope":{{"corpus":true}},"status":"' || stat || '"}}' || chr(10)) AS digest
  FROM reports r JOIN pairs p USING (case_id) LEFT JOIN whole w USING (case_id)
  LEFT JOIN limited l USING (case_id, max_length) LEFT JOIN source_limited s USING (case_id, max_length))"""


def _conv(select: str, turns: str = "conversations") -> str:
    return "WITH " + _CODED.replace("{turns}", turns) + " " + select


def _trace(select: str, turns: str = "conversations", extra: str = "") -> str:
    return "WITH " + _CODED.replace("{turns}", turns) + _TOKENS + extra + " " + select


def _pair(select: str, extra: str = "", turns: str = "conversations") -> str:
    return "WITH " + _PAIRS.replace("{turns}", turns) + extra + " " + select


def _report(select: str, lengths: str = "256", extra: str = "") -> str:
    return "WITH " + _PAIRS.replace("{turns}", "conversations") + _ENCODED + _OWNED + _CUT.replace("{lengths}", lengths) + extra + " " + select


_QUIET = ("(SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN '' "
          "ELSE text END AS text FROM conversations)")
_LONG = ("(SELECT conv_id, turn + d AS turn, role, repeat(text, greatest(1, 8192 // greatest(1, strlen(text)))::INT) AS text "
         "FROM conversations, (VALUES (0), (100)) AS v(d))")
_STRETCHED = """(SELECT conv_id, turn * 3 + conv_id % 5 AS turn, role, text FROM conversations WHERE conv_id % 3 <> 0
  UNION ALL SELECT -1 - conv_id % 2, conv_id * 64 + turn + k * 1000000, role, text
    FROM conversations, range(30) AS r(k) WHERE conv_id % 3 = 0
  UNION ALL SELECT c, t, role, text FROM (
    SELECT c, conv_id * 2 + turn AS t, role, text, row_number() OVER (PARTITION BY c ORDER BY conv_id * 2 + turn) AS n
    FROM conversations, (VALUES (-65), (-66)) AS v(c) WHERE turn < 2 AND role IN ('user', 'assistant') AND conv_id < 40) WHERE n <= -c)"""
_SHORT_WORDS = "(SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN repeat('a ', 2100) ELSE text END AS text FROM conversations)"
_TEN = "(substr(example_id, 6)::BIGINT) % 10"


def _list_ids(pieces: str) -> str:
    return f"list_concat([1], list_transform({pieces}, lambda p: {_ID.format(p='p')}))"


def _joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


_INPUT_IDS = f"({_list_ids('cp0')})[1:256]"
_EXAMPLES = f""",
ex AS (
  SELECT *, regexp_extract_all(source, '{_PATTERN}') AS sp0, regexp_extract_all(source || target, '{_PATTERN}') AS cp0
  FROM pairs),
seq AS (SELECT *, {_INPUT_IDS} AS ids, least(len(sp0) + 1, 256) AS cutoff FROM ex),
train AS (SELECT *, list_transform(ids, lambda t, i: CASE WHEN i <= cutoff THEN -100 ELSE t END) AS labels FROM seq)"""
_BATCHES = _EXAMPLES + """,
sharded AS (SELECT *, (floor(conv_id / 64) * 1048576 + floor(turn / 4096))::BIGINT AS shard FROM train),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY conv_id, turn) - 1) // 8 AS batch FROM sharded),
wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY shard, batch) AS width FROM ranked)"""

_IN_ORDER = _EXAMPLES + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM train),
wide AS (SELECT *, place // 8 AS batch, max(len(ids)) OVER (PARTITION BY place // 8) AS width FROM ranked)"""

_CASE_DOC = ("'{\"case_id\":' || to_json(case_id)::VARCHAR || ',\"max_length\":' || {n} || "
             "',\"schema_version\":\"token-boundary-synthetic-case-v1\",\"source\":' || to_json(source)::VARCHAR || "
             "',\"target\":' || to_json(target)::VARCHAR || '}' || chr(10)")
# ASCII escaping of a document, one character at a time (all texts stay below U+10000).
_ASCII = ("array_to_string(list_transform(regexp_extract_all({doc}, '(?s).'), lambda c: "
          "CASE WHEN unicode(c) > 127 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END), '')")


def _case_sha(n: str) -> str:
    return f"sha256({_ASCII.format(doc=_CASE_DOC.replace('{n}', n))})"


_LABEL_LISTS = "SELECT example_id, policy, {cols} FROM labels_t GROUP BY example_id, policy"
_AUDIT = """SELECT example_id,
  coalesce(string_agg(CASE WHEN {on} AND NOT el AND cat = 'boundary' THEN pos END, '|' ORDER BY pos), '') AS boundary_leakage_positions,
  coalesce(string_agg(CASE WHEN {on} AND cat = 'padding' THEN pos END, '|' ORDER BY pos), '') AS padding_leakage_positions,
  coalesce(string_agg(CASE WHEN {on} AND NOT el THEN pos END, '|' ORDER BY pos), '') AS off_policy_supervision_positions,
  coalesce(string_agg(CASE WHEN NOT ({on}) AND el THEN pos END, '|' ORDER BY pos), '') AS missing_eligible_positions"""


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["sft_prompts"] = _pair(
        "SELECT case_id, 'You are a helpful assistant.' || chr(10) || '### Instruction:' || chr(10) || "
        f"regexp_replace(regexp_replace(source, '^{_WS}+', ''), '{_WS}+$', '') || chr(10) || '### Response:' || chr(10) AS source, "
        "target || chr(10) || '<|EOT|>' AS target FROM pairs")
    out["concatenated_pairs"] = _pair("SELECT case_id, md5(source || target) AS combined_md5, length(source)::INT AS boundary FROM pairs")
    out["case_identities"] = _pair(
        f"SELECT case_id, {_case_sha('256')} AS canonical_sha256, length(source)::INT AS source_codepoints, "
        "length(target)::INT AS target_codepoints, length(source)::INT AS boundary_codepoint, 256::INT AS max_length FROM pairs")
    out["case_codes"] = _pair(
        "SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'case_id' WHEN turn = 2 THEN 'text.value' "
        "WHEN turn = 3 AND strlen(target) * 9000 > 8192 THEN 'text.size' "
        "WHEN strlen(source) > 8192 OR strlen(target) > 8192 THEN 'text.size' "
        "WHEN turn = 5 THEN 'max_length.type' WHEN turn = 4 THEN 'max_length.range' END AS error_code FROM pairs")
    out["message_codes"] = (
        "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 3 OR role NOT IN ('system','user','assistant') THEN 'message.role' "
        "WHEN strlen(text) * CASE WHEN turn = 3 THEN 60 ELSE 1 END > 8192 THEN 'message.content_limit' END AS error_code FROM conversations")
    out["content_limits"] = _conv("SELECT conv_id, error_code FROM codes", _LONG)
    out["conversation_codes"] = _conv("SELECT conv_id, error_code FROM codes")
    out["turn_order_codes"] = _conv("SELECT conv_id, CASE WHEN NOT ok THEN 'messages.turn_order' END AS error_code FROM orders")
    out["long_conversation_codes"] = _conv(
        "SELECT conv_id, error_code, CASE WHEN n <= 64 THEN n ELSE 0 END AS messages FROM codes JOIN (SELECT conv_id, n FROM flags) USING (conv_id)", _STRETCHED)
    out["long_turn_orders"] = _conv("SELECT conv_id, CASE WHEN NOT ok THEN 'messages.turn_order' END AS error_code FROM orders", _STRETCHED)
    out["gapped_reply_pairs"] = _pair(
        "SELECT conv_id, turn, md5(source) AS source_md5, md5(target) AS target_md5 FROM pairs", turns=_STRETCHED)
    out["gated_traces"] = _conv(
        "SELECT 'conv-' || conv_id AS example_id, CASE WHEN ((2 + sum(2 + len(regexp_extract_all(text, '[^ \\n\\t\\r]+'))) + 7) // 8) * 8 > 4096 "
        "THEN 'token_ids.count' END AS error_code FROM coded JOIN codes USING (conv_id) WHERE error_code IS NULL GROUP BY conv_id", _SHORT_WORDS)
    out["quarantine_counts"] = _conv("SELECT coalesce(error_code, 'valid') AS outcome, count(*) AS conversations FROM codes GROUP BY 1")
    out["redacted_rejects"] = _conv(
        "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'internal.error' ELSE error_code END AS error_code "
        "FROM codes WHERE error_code IS NOT NULL")
    out["trace_exit_codes"] = _conv("SELECT conv_id, CASE WHEN error_code IS NULL THEN 0 ELSE 2 END::BIGINT AS exit_code FROM codes")
    damage = ("CASE {k} WHEN 1 THEN 'token_ids.item' WHEN 2 THEN 'padding_token_id' WHEN 3 THEN 'segments.count' "
              "WHEN 4 THEN 'segments.sequence' WHEN 5 THEN 'segments.coverage' WHEN 6 THEN 'segments.range' "
              "WHEN 7 THEN 'segments.boundary_empty' WHEN 8 THEN 'segment.start' "
              "WHEN 9 THEN CASE WHEN total > used THEN 'trace.padding_mismatch' END END")
    out["trace_codes"] = _trace(f"SELECT example_id, {damage.format(k=_TEN)} AS error_code FROM sizes")
    out["trace_part_codes"] = _trace(
        f"SELECT example_id, CASE {_TEN} WHEN 1 THEN 'token_ids.item' WHEN 2 THEN 'padding_token_id' END AS token_code, "
        f"CASE {_TEN} WHEN 3 THEN 'segments.count' END AS count_code, "
        f"CASE {_TEN} WHEN 8 THEN 'segment.start' END AS shape_code, "
        f"CASE WHEN {_TEN} IN (3, 4) THEN 'segments.sequence' END AS sequence_code FROM sizes")
    out["trace_document_codes"] = _conv(
        "SELECT 'conv-' || conv_id AS record_key, CASE conv_id % 8 WHEN 1 THEN 'json.floating_point_forbidden' "
        "WHEN 2 THEN 'json.duplicate_key' WHEN 3 THEN 'root.fields' WHEN 5 THEN 'json.invalid' "
        "WHEN 4 THEN coalesce(error_code, 'padding_token_id') ELSE error_code END AS error_code FROM codes")
    out["case_document_codes"] = _pair(
        "SELECT case_id AS record_key, CASE conv_id % 6 WHEN 1 THEN 'max_length.type' WHEN 2 THEN 'max_length.range' "
        "WHEN 3 THEN 'schema_version' WHEN 4 THEN 'document.json' END AS error_code FROM pairs")
    out["trace_summaries"] = _trace(
        "SELECT example_id, m.n AS message_count, m.a AS assistant_message_count, total AS token_count, "
        "used AS non_padding_token_count, total - used AS padding_token_count FROM sizes JOIN "
        "(SELECT example_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS a FROM msg GROUP BY 1) m USING (example_id)")
    out["padding_starts"] = _trace("SELECT example_id, used AS padding_start FROM sizes")
    out["eligible_positions"] = _trace(
        "SELECT example_id, string_agg(CASE WHEN cat <> 'padding' THEN pos END, '|' ORDER BY pos) AS all_tokens, "
        "coalesce(string_agg(CASE WHEN cat = 'assistant' THEN pos END, '|' ORDER BY pos), '') AS assistant_only FROM tok GROUP BY 1")
    out["boundary_positions"] = _trace(
        "SELECT example_id, string_agg(CASE WHEN cat = 'boundary' THEN pos END, '|' ORDER BY pos) AS positions FROM tok GROUP BY 1")
    out["token_category_counts"] = _trace(
        "SELECT cat AS category, count(*) AS tokens, count(*) FILTER (cat = 'assistant') AS supervised FROM tok GROUP BY 1")
    out["built_labels"] = _trace(_LABEL_LISTS.format(cols="string_agg(label, '|' ORDER BY pos) AS labels"))
    out["label_codes"] = _trace(
        "SELECT example_id, policy, CASE m.n % 4 WHEN 0 THEN 'labels.length' WHEN 1 THEN "
        "CASE WHEN max(CASE WHEN pos = 2 THEN token END) <> 5 THEN 'labels.token_mismatch' END "
        "WHEN 2 THEN 'labels.type' END AS error_code FROM labels_t JOIN "
        "(SELECT example_id, count(*) AS n FROM msg GROUP BY 1) m USING (example_id) GROUP BY example_id, policy, m.n")
    out["label_counts"] = _trace(
        "SELECT example_id, policy, count(*) FILTER (eligible) AS eligible_token_count, count(*) FILTER (eligible) AS supervised_token_count, "
        "count(*) FILTER (NOT eligible) AS ignored_token_count, "
        "count(*) FILTER (eligible AND cat = 'boundary') AS boundary_supervised_token_count FROM lab GROUP BY 1, 2")
    out["supervised_positions"] = _trace(_LABEL_LISTS.format(
        cols="coalesce(string_agg(CASE WHEN eligible THEN pos END, '|' ORDER BY pos), '') AS positions"))
    islands = (", isl AS (SELECT example_id, policy, pos, pos - row_number() OVER (PARTITION BY example_id, policy ORDER BY pos) AS g "
               "FROM lab WHERE eligible), runs AS (SELECT example_id, policy, min(pos) AS s, max(pos) + 1 AS e FROM isl GROUP BY example_id, policy, g)")
    out["supervised_runs"] = _trace(
        "SELECT l.example_id, l.policy, coalesce(string_agg(s || '-' || e, '|' ORDER BY s), '') AS runs FROM "
        "(SELECT DISTINCT example_id, policy FROM lab) l LEFT JOIN runs USING (example_id, policy) GROUP BY 1, 2", extra=islands)
    out["token_runs"] = _trace("SELECT example_id, policy, s AS run_start, e AS run_end FROM runs", extra=islands)
    out["token_categories"] = _trace(
        "SELECT example_id, cat AS category, count(*) AS tokens, sum(pos)::BIGINT AS pos_sum, sum(token)::BIGINT AS id_sum FROM tok GROUP BY 1, 2")
    out["label_digests"] = _trace(_LABEL_LISTS.format(
        cols="sha256('[' || string_agg(label, ',' ORDER BY pos) || ']' || chr(10)) AS labels_sha256"))
    empties = ", quiet AS (SELECT example_id, string_agg(CASE WHEN role = 'assistant' AND len(w) = 0 THEN i END, '|' ORDER BY i) AS e FROM msg GROUP BY 1)"
    out["empty_targets"] = _trace(
        "SELECT example_id, CASE WHEN e IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(e, '') AS indices, "
        "CASE WHEN e IS NULL THEN '' ELSE 'assistant_target.empty' END AS issue_codes FROM quiet", _QUIET, empties)
    out["supplied_label_audit"] = _trace(
        _AUDIT.format(on="cat <> 'padding'").replace(" el", " (cat = 'assistant')") + " FROM tok GROUP BY 1")
    number = "substr(example_id, 6)::BIGINT % 4"
    out["unmatched_labels"] = _trace(
        f"SELECT example_id, CASE WHEN {number} IN (1, 2) THEN 'labels.missing' END AS code, CASE WHEN {number} NOT IN (1, 2) THEN '' END AS missing_eligible_positions, "
        f"CASE WHEN {number} NOT IN (1, 2) THEN count(*) END AS tokens FROM tok GROUP BY example_id "
        f"UNION ALL SELECT 'other-' || example_id, 'trace.missing', NULL, count(*) FROM tok WHERE {number} = 1 GROUP BY example_id")
    out["audit_invariants"] = _trace(
        "SELECT example_id, 'assistant_only' AS policy, 'audit.internal_invariant' AS code, 'damaged' AS labels FROM tok "
        "WHERE (substr(example_id, 6)::BIGINT) % 3 < 2 GROUP BY example_id "
        "HAVING any_value(substr(example_id, 6)::BIGINT) % 3 = 0 OR count(*) FILTER (cat = 'assistant') > 0")
    out["trace_audit_rollup"] = _trace(
        "SELECT CASE WHEN e IS NULL THEN 'pass' ELSE 'fail' END AS status, count(DISTINCT example_id) AS traces, "
        "count(*) FILTER (cat = 'assistant') AS supervised_token_count, count(*) FILTER (cat <> 'assistant') AS ignored_token_count, "
        "count(*) FILTER (cat = 'padding') AS padding_token_count FROM tok JOIN quiet USING (example_id) GROUP BY 1", _QUIET, empties)
    doc = (
        ", mj AS (SELECT example_id, string_agg('{\"content\":' || to_json(text)::VARCHAR || ',\"role\":\"' || role || '\"}', ',' ORDER BY i) AS j FROM msg GROUP BY 1), "
        "ms AS (SELECT example_id, string_agg('{\"end\":' || (s + 1) || ',\"kind\":\"message_start\",\"message_index\":' || i || ',\"start\":' || s || '},' || "
        "'{\"end\":' || (e - 1) || ',\"kind\":\"message_content\",\"message_index\":' || i || ',\"start\":' || (s + 1) || '},' || "
        "'{\"end\":' || e || ',\"kind\":\"message_end\",\"message_index\":' || i || ',\"start\":' || (e - 1) || '}', ',' ORDER BY i) AS j FROM message_spans GROUP BY 1), "
        "tj AS (SELECT example_id, string_agg(token, ',' ORDER BY pos) AS j FROM tok GROUP BY 1), "
        "docs AS (SELECT example_id, sha256('{\"conversation\":{\"messages\":[' || mj.j || ']},\"example_id\":\"' || example_id || "
        "'\",\"kind\":\"loss-topology.synthetic-pretokenized-trace\",\"schema_version\":1,\"trace\":{\"padding_token_id\":0,\"segments\":["
        "{\"end\":1,\"kind\":\"prefix_special\",\"message_index\":null,\"start\":0},' || ms.j || ',{\"end\":' || used || "
        "',\"kind\":\"suffix_special\",\"message_index\":null,\"start\":' || (used - 1) || '},{\"end\":' || total || "
        "',\"kind\":\"padding\",\"message_index\":null,\"start\":' || used || '}],\"token_ids\":[' || tj.j || ']}}' || chr(10)) AS sha "
        "FROM sizes JOIN mj USING (example_id) JOIN ms USING (example_id) JOIN tj USING (example_id))")
    out["trace_digests"] = _trace("SELECT example_id, sha AS trace_sha256 FROM docs", extra=_SEGMENTS + doc)
    policy_doc = (
        ", pj AS (SELECT l.example_id, l.policy, '{\"boundary_leakage_positions\":[],\"boundary_supervised_token_count\":' || "
        "count(*) FILTER (eligible AND cat = 'boundary') || ',\"eligible_token_count\":' || count(*) FILTER (eligible) || "
        "',\"ignored_token_count\":' || count(*) FILTER (NOT eligible) || ',\"labels\":[' || string_agg(label, ',' ORDER BY pos) || "
        "'],\"labels_sha256\":\"' || sha256('[' || string_agg(label, ',' ORDER BY pos) || ']' || chr(10)) || "
        "'\",\"missing_eligible_positions\":[],\"off_policy_supervision_positions\":[],\"padding_leakage_positions\":[],\"policy\":\"' || l.policy || "
        "'\",\"supervised_runs\":[' || coalesce(max(r.j), '') || '],\"supervised_token_count\":' || count(*) FILTER (eligible) || '}' AS j "
        "FROM labels_t l LEFT JOIN (SELECT example_id, policy, string_agg('{\"end\":' || e || ',\"length\":' || (e - s) || ',\"start\":' || s || '}', ',' ORDER BY s) AS j "
        "FROM runs GROUP BY 1, 2) r ON r.example_id = l.example_id AND r.policy = l.policy GROUP BY l.example_id, l.policy)")
    empties_j = ", quiet AS (SELECT example_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS a, string_agg(CASE WHEN role = 'assistant' AND len(w) = 0 THEN i END, ',' ORDER BY i) AS e FROM msg GROUP BY 1)"
    out["trace_audit_reports"] = _trace(
        "SELECT example_id, CASE WHEN e IS NULL THEN 'pass' ELSE 'fail' END AS status, sha256("
        "'{\"diagnostics\":{\"empty_assistant_message_indices\":[' || coalesce(e, '') || '],\"issue_codes\":[' || "
        "CASE WHEN e IS NULL THEN '' ELSE '\"assistant_target.empty\"' END || ']},\"example_id\":\"' || example_id || '\",\"input_sha256\":\"' || sha || "
        "'\",\"kind\":\"loss-topology.audit\",\"policies\":{\"all_tokens\":' || a.j || ',\"assistant_only\":' || b.j || "
        "'},\"schema_version\":1,\"scope\":{\"causal_shift_or_loss_computed\":false,\"input_class\":\"caller-supplied-synthetic-pretokenized-json\","
        "\"model_or_dataset_loaded\":false,\"quality_metric\":null,\"tokenizer_executed\":false,\"tokenizer_mapping_attested\":false,"
        "\"trainer_imported_or_executed\":false},\"status\":\"' || CASE WHEN e IS NULL THEN 'pass' ELSE 'fail' END || "
        "'\",\"trace_summary\":{\"assistant_message_count\":' || q.a || ',\"message_count\":' || q.n || ',\"non_padding_token_count\":' || used || "
        "',\"padding_token_count\":' || (total - used) || ',\"token_count\":' || total || '}}' || chr(10)) AS audit_sha256 "
        "FROM docs JOIN quiet q USING (example_id) JOIN sizes USING (example_id) "
        "JOIN (SELECT * FROM pj WHERE policy = 'all_tokens') a USING (example_id) JOIN (SELECT * FROM pj WHERE policy = 'assistant_only') b USING (example_id)",
        extra=_SEGMENTS + doc + islands + policy_doc + empties_j)
    faulted = (", f AS (SELECT t.example_id, pos, cat, cat = 'assistant' AS el, CASE WHEN pos = 0 OR pos = total - 1 THEN true "
               "WHEN pos = first THEN false ELSE cat = 'assistant' END AS sup FROM tok t JOIN sizes USING (example_id) JOIN "
               "(SELECT example_id, min(CASE WHEN cat = 'assistant' THEN pos END) AS first FROM tok GROUP BY 1) USING (example_id)), "
               "fi AS (SELECT example_id, pos, pos - row_number() OVER (PARTITION BY example_id ORDER BY pos) AS g FROM f WHERE sup), "
               "fr AS (SELECT example_id, string_agg(s || '-' || e, '|' ORDER BY s) AS runs FROM "
               "(SELECT example_id, min(pos) AS s, max(pos) + 1 AS e FROM fi GROUP BY example_id, g) GROUP BY 1)")
    out["injected_faults"] = _trace(
        _AUDIT.format(on="sup") + ", max(runs) AS runs FROM f JOIN fr USING (example_id) GROUP BY example_id", extra=faulted)
    out["policy_comparison"] = _trace(
        "SELECT example_id, c.a AS all_supervised, c.b AS assistant_supervised, c.ab AS all_boundary, r.a AS all_runs, coalesce(r.b, 0) AS assistant_runs FROM "
        "(SELECT example_id, count(*) FILTER (cat <> 'padding') AS a, count(*) FILTER (cat = 'assistant') AS b, "
        "count(*) FILTER (cat = 'boundary') AS ab FROM tok GROUP BY 1) c LEFT JOIN "
        "(SELECT example_id, count(*) FILTER (policy = 'all_tokens') AS a, count(*) FILTER (policy = 'assistant_only') AS b FROM runs GROUP BY 1) r USING (example_id)",
        extra=islands)
    out["token_lengths"] = f"SELECT doc_id, len(regexp_extract_all(text, '{_PATTERN}')) + 1 AS tokens FROM documents"
    out["masked_examples"] = _pair(
        f"SELECT case_id, md5({_joined('ids')}) AS ids_md5, md5({_joined('labels')}) AS labels_md5, "
        "least(cutoff, len(ids))::BIGINT AS masked FROM train", _EXAMPLES)
    padded = "list_concat(labels, list_transform(range(0, width - len(ids)), lambda x: -100))"
    out["padded_batches"] = _pair(
        f"SELECT case_id, shard, batch, width, md5({_joined(padded)}) AS labels_md5 FROM wide", _BATCHES, _STRETCHED)
    out["dataset_order_batches"] = _pair(
        f"SELECT case_id, place, batch, width, md5({_joined(padded)}) AS labels_md5 FROM wide", _IN_ORDER, _STRETCHED)
    out["mapped_batches"] = (
        "SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, length(text) AS chars, "
        "count(*) OVER (PARTITION BY (row_number - 1) // 7) AS rows FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_number FROM documents)")
    out["attention_masks"] = _pair(
        "SELECT case_id, len(list_filter(ids, lambda t: t <> 0)) AS attended, width FROM wide", _BATCHES, _STRETCHED)
    out["sampled_examples"] = _pair("SELECT case_id, source, target FROM pairs ORDER BY md5(case_id || ':7'), case_id LIMIT 3")
    apart = "replace(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'ç', 'c' || chr(807))"
    out["nfc_documents"] = f"SELECT doc_id, md5(nfc_normalize({apart})) AS nfc_md5 FROM documents"
    out["stripped_documents"] = (
        f"SELECT doc_id, md5(regexp_replace(t, '{_WS}+$', '')) AS stripped_md5, length(t) - length(regexp_replace(t, '{_WS}+$', '')) AS removed "
        "FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' ' || chr(9) || ' ' || chr(28) || chr(10) ELSE '' END AS t FROM documents)")
    out["document_pieces"] = (
        f"SELECT doc_id, len(p) AS pieces, len(list_filter(p, lambda x: length(x) > 1)) AS merged FROM "
        f"(SELECT doc_id, regexp_extract_all(text, '{_PATTERN}') AS p FROM documents)")
    accent = "(SELECT case_id, source || 'e' AS source, chr(769) || target AS target FROM pairs)"
    out["normalization_snapshots"] = _pair(
        "SELECT case_id, length(c) AS combined_raw_count, length(nfc_normalize(c)) AS combined_nfc_count, "
        f"length(regexp_replace(nfc_normalize(c), '{_WS}+$', '')) AS combined_normalized_count, true AS combined_complete, "
        "(length(source) - 1)::VARCHAR AS cross_positions, true AS runtime_matches FROM "
        f"(SELECT *, source || target AS c FROM {accent})")
    cut = lambda e: f"md5({_joined(e)})"
    ends = "list_concat([0], list_transform(range(1, least(len(cp), 255) + 1), lambda i: length(array_to_string(cp[1:i], ''))))"
    out["encodings"] = _pair(
        f"SELECT case_id, {cut('(' + _list_ids('sp') + ')[1:256]')} AS source_truncated_md5, {cut(_list_ids('cp'))} AS combined_full_md5, "
        f"{cut('(' + _list_ids('cp') + ')[1:256]')} AS combined_truncated_md5, {cut(ends)} AS offsets_md5, true AS exact_prefix FROM enc", _ENCODED)
    out["token_ownership"] = "WITH " + _PAIRS.replace("{turns}", "conversations") + _ENCODED + _OWNED + (
        " SELECT case_id, 1::BIGINT AS injected_prefix, count(*) FILTER (owner = 'source') AS source, count(*) FILTER (owner = 'target') AS target, "
        "count(*) FILTER (owner = 'cross_boundary') AS cross_boundary, 0::BIGINT AS ambiguous FROM owned GROUP BY 1")
    out["nonprefix_ownership"] = _report(
        "SELECT case_id, 'indeterminate' AS status, concat_ws('|', 'indeterminate', CASE WHEN crossing IS NOT NULL THEN 'cross_boundary_token' END) AS classifications, "
        "concat_ws('|', CASE WHEN absent THEN 'target.no_attributable_token' END, 'truncation.not_exact_prefix') AS reasons, (kept - 1)::BIGINT AS ambiguous FROM reports")
    # Marks of two kinds in one cluster, a vowel sign that joins the consonant before it, a separator that only one
    # side strips, text outside a vocabulary, pieces that left the text; a text with none of its target's letters has one more.
    out["boundary_reasons"] = _pair(
        "SELECT case_id, 'indeterminate' AS status, CASE conv_id % 5 "
        "WHEN 0 THEN CASE WHEN regexp_matches(source || target, '[^ abcdefghixé]') THEN 'encoding.piece_alignment|encoding.unknown_token' END "
        "WHEN 1 THEN CASE WHEN length(nfc_normalize(chr(4352) || chr(4449))) = 1 THEN 'normalization.cluster_replay|normalization.provenance_ambiguous' END "
        "WHEN 2 THEN CASE WHEN length(nfc_normalize('a' || chr(789) || chr(768))) = 2 THEN 'normalization.provenance_ambiguous' END "
        "WHEN 3 THEN 'encoding.piece_alignment|normalization.provenance_ambiguous|normalization.runtime_mismatch' "
        "ELSE 'encoding.piece_alignment' END AS reasons FROM pairs")
    out["boundary_diagnostics"] = _report(
        "SELECT case_id, cutoff, oracle AS oracle_cutoff, coalesce(leak, '') AS prompt_leakage_positions, "
        "coalesce(hidden, '') AS masked_retained_target_positions, coalesce(crossing, '') AS cross_boundary_positions, '' AS ambiguous_positions, "
        "full_n AS full_target_token_count, kept_n AS retained_target_token_count, shown_n AS supervised_target_token_count, "
        "full_n - kept_n AS truncated_target_token_count, causes AS elimination_causes, reasons AS indeterminate_reasons FROM reports")
    out["boundary_classes"] = _report("SELECT case_id, stat AS status, prim AS primary_classification, classes AS classifications FROM reports")
    out["mask_positions"] = _report("SELECT case_id, least(cutoff, kept) AS masked, kept - least(cutoff, kept) AS supervised FROM reports")
    swapped = _PAIRS.replace("{turns}", "conversations") + f", shifted AS (SELECT conv_id, turn, case_id, source || 'e' AS source, target AS target FROM pairs)"
    # After NFC the accent folds into the source's last e: the composed token is the only one across.
    out["unicode_boundary_classes"] = "WITH " + swapped + f""",
enc AS (SELECT case_id, length(source) AS b,
    regexp_extract_all(source, '{_PATTERN}') AS sp,
    regexp_extract_all(nfc_normalize(source || chr(769) || target), '{_PATTERN}') AS cp FROM shifted)""" + _OWNED.replace(
        "CASE WHEN e <= b THEN 'source' WHEN e - length(p) >= b THEN 'target' ELSE 'cross_boundary' END",
        "CASE WHEN e <= b - 1 THEN 'source' WHEN e - length(p) >= b THEN 'target' ELSE 'cross_boundary' END") + (
        " SELECT case_id, 'cross_boundary_token' AS primary_classification, "
        "string_agg(CASE WHEN owner = 'cross_boundary' THEN pos END, '|' ORDER BY pos) AS \"cross\" FROM owned GROUP BY 1")
    out["report_digests"] = _report("SELECT case_id, stat AS status, digest AS report_sha256 FROM digested", extra=_digests())
    out["stored_reports"] = _report("SELECT digest AS report_sha256 FROM digested", extra=_digests())
    out["report_violations"] = _report(
        "SELECT CASE WHEN least(cutoff, kept) % 4 = 1 THEN 'report.legacy_cutoff' WHEN least(cutoff, kept) % 4 = 2 THEN 'report.retained_target_count' "
        "WHEN least(cutoff, kept) % 4 = 3 THEN CASE WHEN stat = 'indeterminate' THEN 'none' ELSE 'report.status' END ELSE 'none' END AS first_code, "
        "count(*) AS reports FROM reports GROUP BY 1")
    out["report_violation_rows"] = _report(
        "SELECT case_id, ['report.status', 'legacy_mask.cutoff', 'normalization.raw_codepoint_count', 'attribution.ownership', "
        "'report.full_attribution.length', 'diagnostics.full_target_token_count'][1 + least(cutoff, kept) % 7] AS first_code "
        "FROM reports WHERE least(cutoff, kept) % 7 < 6")
    blob = "encode(text)"
    lines = ("(len(regexp_extract_all({t}, '\\r\\n|\\n|\\r')) + CASE WHEN regexp_matches({t}, '[^\\r\\n]$') THEN 1 ELSE 0 END)::BIGINT")
    git = "sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text))"
    out["file_identities"] = (
        f"SELECT 'doc/' || doc_id AS path, strlen(text) AS byte_length, {lines.format(t='text')} AS line_count, "
        f"sha256({blob}) AS sha256, {git} AS git_blob_sha1 FROM documents")
    out["artifact_manifest"] = f"SELECT 'doc/' || doc_id AS path, strlen(text) AS bytes, sha256({blob}) AS sha256 FROM documents"
    out["unread_manifest"] = (
        f"SELECT path, bytes, CASE WHEN keep THEN sha256 END AS sha256 FROM (SELECT 'doc/' || doc_id AS path, strlen(text) AS bytes, sha256({blob}) AS sha256, "
        f"md5('doc/' || doc_id) >= '6' AS keep FROM documents)")
    out["bound_identity"] = "SELECT 'doc/5' AS path, NULL::VARCHAR AS code WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = 5)"
    out["file_drift"] = (
        "SELECT path, code FROM (SELECT 'doc/' || doc_id AS path, CASE WHEN lang = 'de' AND strlen(text) > 200 THEN 'file.missing' "
        "WHEN lang <> 'de' AND strlen(text) <= 200 THEN 'file.unlisted' WHEN lang = 'fr' THEN 'file.byte_length' "
        "WHEN lang <> 'de' AND doc_id % 11 = 0 THEN 'file.unread' WHEN lang = 'es' AND contains(text, 'e') THEN 'file.sha256' "
        "WHEN lang = 'en' AND doc_id % 7 = 0 THEN 'file.git_mode' END AS code FROM documents) WHERE code IS NOT NULL "
        "UNION ALL SELECT 'old/doc/' || doc_id, 'file.missing' FROM documents WHERE strlen(text) <= 200")
    out["semantic_props"] = (
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN sha256(p || chr(10)) "
        "WHEN 1 THEN sha256('{\"p\":' || p || ',\"z\":[1,{\"a\":true,\"b\":null}],\"é\":\"A/\"}' || chr(10)) "
        "WHEN 2 THEN sha256('[0,1.5,2000,0,1.2345678901E+10,1E+9,' || p || ']' || chr(10)) END AS semantic_sha256 "
        "FROM (SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS p FROM events)")
    out["golden_drift"] = (
        "SELECT * FROM (SELECT 'doc/' || doc_id AS name, CASE lang WHEN 'de' THEN 'golden.extra' WHEN 'fr' THEN 'golden.missing' "
        "WHEN 'es' THEN 'golden.content' END AS code FROM documents) WHERE code IS NOT NULL")
    out["bound_paths"] = (
        "SELECT * FROM (VALUES ('doc/0', NULL), ('doc/1', 'file.byte_length'), ('doc/2', 'file.missing'), ('doc/3', 'file.unlisted')) AS v(path, code) "
        "WHERE EXISTS (SELECT 1 FROM documents WHERE path = 'doc/' || doc_id) UNION ALL SELECT 'doc/none', 'file.missing'")
    out["golden_nulls"] = (
        "SELECT * FROM (SELECT 'doc/' || doc_id AS name, CASE doc_id % 7 WHEN 0 THEN 'golden.extra' WHEN 3 THEN 'golden.missing' "
        "WHEN 2 THEN 'golden.content' WHEN 4 THEN 'golden.content' END AS code FROM documents) WHERE code IS NOT NULL")
    out["stored_golden_drift"] = (
        "SELECT * FROM (SELECT 'doc/' || doc_id AS name, CASE doc_id % 61 WHEN 0 THEN 'golden.missing' WHEN 1 THEN 'golden.extra' "
        "WHEN 3 THEN 'golden.content' WHEN 4 THEN 'golden.content' END AS code FROM documents) WHERE code IS NOT NULL")
    out["unexpected_results"] = (
        "SELECT doc_id, 'digest' AS field, CASE WHEN doc_id % 5 NOT IN (2, 3) THEN md5(text) END AS expected, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS observed "
        "FROM documents WHERE doc_id % 5 IN (0, 2, 3) UNION ALL "
        "SELECT doc_id, 'lang', CASE WHEN doc_id % 5 = 0 THEN lang END, CASE WHEN doc_id % 5 = 2 THEN lang END FROM documents WHERE doc_id % 5 IN (0, 2)")
    out["expectation_mismatches"] = _report(
        "SELECT case_id, 'status' AS field, 'pass' AS expected, stat AS observed FROM reports WHERE stat <> 'pass' "
        "UNION ALL SELECT case_id, 'primary_classification', 'aligned', prim FROM reports WHERE prim <> 'aligned'")
    probes = "('the end'), ('h'), ('é'), (chr(769) || ' tail')"
    # A composing accent leaves one normalized character across the boundary.
    crossing = _OWNED.replace("case_id, b, u.k", "case_id, lo, hi, u.k").replace(
        "CASE WHEN e <= b THEN 'source' WHEN e - length(p) >= b THEN", "CASE WHEN e <= lo THEN 'source' WHEN e - length(p) >= hi THEN")
    out["input_matrix"] = f"""WITH grid AS (
  SELECT conv_id, turn, text AS source, probe, text || probe AS raw, nfc_normalize(text || probe) AS form
  FROM conversations, (VALUES {probes}) AS p(probe) WHERE role = 'user'),
enc AS (
  SELECT conv_id || '/' || turn || '/' || probe AS case_id, length(source) AS hi,
    length(source) - (length(raw) - length(form)) AS lo,
    regexp_extract_all(source, '{_PATTERN}') AS sp, regexp_extract_all(form, '{_PATTERN}') AS cp FROM grid)""" + (
        crossing + _CUT.replace("{lengths}", "32, 128") +
        " SELECT classes AS classifications, count(*) AS cases FROM reports GROUP BY 1")
    out["turn_matrix"] = f"""WITH enc AS (
  SELECT u.conv_id || '/' || u.turn || '/' || a.conv_id || '/' || a.turn AS case_id, length(u.text) AS b,
    regexp_extract_all(regexp_replace(u.text, '\\s+$', ''), '{_PATTERN}') AS sp,
    regexp_extract_all(regexp_replace(u.text || a.text, '\\s+$', ''), '{_PATTERN}') AS cp
  FROM conversations u, conversations a WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL)""" + (
        _OWNED + _CUT.replace("{lengths}", "32, 128") + " SELECT classes AS classifications, count(*) AS cases FROM reports GROUP BY 1")
    every = ", ".join(map(str, range(2, 513)))
    out["all_lengths_sweep"] = _report(
        "SELECT max_length::BIGINT AS max_length, prim AS primary_classification, count(*) AS cells, sum(cutoff)::BIGINT AS legacy_cutoff, "
        "sum(oracle)::BIGINT AS oracle_cutoff, sum(kept_n)::BIGINT AS retained_target_tokens, sum(shown_n)::BIGINT AS supervised_target_tokens, "
        "sum(full_n - kept_n)::BIGINT AS truncated_target_tokens, sum(length(coalesce(leak, '')))::BIGINT AS leak_letters FROM reports GROUP BY 1, 2", every)
    out["sweep_lookups"] = _report(
        "SELECT case_id, max_length::BIGINT AS max_length, CASE WHEN stat = 'pass' THEN 0 ELSE 1 END::BIGINT AS exit_code, stat AS status, "
        "prim AS primary_classification, cutoff AS legacy_cutoff, oracle AS oracle_cutoff, full_n AS full_target_tokens, kept_n AS retained_target_tokens, "
        "shown_n AS supervised_target_tokens, coalesce(leak, '') AS prompt_leakage_positions, coalesce(crossing, '') AS cross_boundary_positions, "
        "causes AS elimination_causes, reasons AS indeterminate_reasons FROM reports JOIN pairs USING (case_id) "
        "WHERE max_length = 2 + (conv_id * 37 + turn * 11) % 511", every)
    sweep = "64, 128, 256, 512"
    out["sft_rows"] = _pair("SELECT md5(source) AS instruction_md5, md5(target) AS output_md5 FROM pairs")
    outcome = "SELECT coalesce(error_code, 'valid') AS outcome, count(*) AS documents FROM ({q}) GROUP BY 1"
    out["trace_lines"] = outcome.format(q=out["trace_document_codes"])
    out["case_lines"] = outcome.format(q=out["case_document_codes"])
    # CR, LF and CRLF each end one line.
    ends = "(len(regexp_extract_all(t, '\\r\\n|\\n|\\r')) + CASE WHEN t = '' OR right(t, 1) IN (chr(10), chr(13)) THEN 0 ELSE 1 END)"
    out["scanned_files"] = (
        f"SELECT 'source=' || source || '/part=' || part AS path, strlen(t) AS byte_length, {ends}::BIGINT AS line_count, sha256(t) AS sha256 FROM ("
        "SELECT source, doc_id // 100 AS part, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1, 2) "
        "UNION ALL SELECT '_SUCCESS', 0, 0, sha256('')")
    out["line_offsets"] = (
        "SELECT 'source=' || source AS path, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", "
        "strlen(t) AS size, CASE WHEN strlen(t) <= 2000 THEN md5(t) END AS payload_md5 "
        "FROM (SELECT source, doc_id, replace(replace(text, chr(13), ' '), chr(10), ' ') AS t FROM documents)")
    out["manifest_codes"] = (
        "SELECT doc_id, code AS error_code, CASE WHEN code IS NULL THEN sha256(text) END AS sha256 FROM (SELECT *, CASE doc_id % 16 "
        "WHEN 1 THEN 'manifest.file.sha256' WHEN 2 THEN 'manifest.duplicate_key' WHEN 3 THEN 'manifest.file.byte_length' WHEN 4 THEN 'manifest.number' "
        "WHEN 5 THEN 'manifest.file.byte_length' WHEN 6 THEN 'manifest.file.git_mode' WHEN 7 THEN 'manifest.file.fields' WHEN 8 THEN 'manifest.version' "
        "WHEN 9 THEN 'manifest.kind' WHEN 10 THEN 'manifest.fields' WHEN 11 THEN 'manifest.files' WHEN 12 THEN 'manifest.file.type' "
        "WHEN 13 THEN 'manifest.file.duplicate' WHEN 14 THEN 'manifest.json' WHEN 15 THEN 'manifest.size' END AS code FROM documents)")
    out["manifest_rows"] = (
        f"SELECT 'doc/' || doc_id AS path, strlen(text) AS byte_length, '100644' AS git_mode, sha256({blob}) AS sha256 FROM documents")
    fixture = "CASE WHEN substr(case_id, 6, instr(substr(case_id, 6), '-') - 1)::BIGINT % 2 = 0 THEN {x} END"
    flat = (
        "max_length::BIGINT AS max_length, CASE WHEN stat = 'pass' THEN 0 ELSE 1 END::BIGINT AS exit_code, stat AS status, prim AS primary_classification, "
        "cutoff AS legacy_cutoff, oracle AS oracle_cutoff, full_n AS full_target_tokens, kept_n AS retained_target_tokens, shown_n AS supervised_target_tokens, "
        "full_n - kept_n AS truncated_target_tokens, {n}coalesce(leak, ''){m} AS prompt_leakage_positions, {n}coalesce(crossing, ''){m} AS cross_boundary_positions, "
        "{n}causes{m} AS elimination_causes, {n}reasons{m} AS indeterminate_reasons FROM digested JOIN pairs USING (case_id)")
    hashes = f"{_case_sha('max_length')} AS canonical_input_sha256, digest AS stdout_sha256, "
    out["truncation_sweep"] = _report(
        f"SELECT case_id, {fixture.format(x="'cases/' || case_id")} AS base_fixture_path, "
        f"{fixture.format(x='sha256(source || target)')} AS fixture_raw_sha256, {hashes}{flat.format(n='', m='')}", sweep, _digests())
    out["stored_sweep"] = _report(
        "SELECT case_id, NULL::VARCHAR AS base_fixture_path, NULL::VARCHAR AS fixture_raw_sha256, "
        f"{hashes}{flat.format(n='nullif(', m=", '')")}", sweep, _digests())
    out["sweep_input_digests"] = _pair(
        f"SELECT case_id, max_length::BIGINT AS max_length, {_case_sha('max_length')} AS canonical_input_sha256 "
        f"FROM pairs, unnest([{sweep}]) AS l(max_length)")
    letter = ("CASE prim WHEN 'aligned' THEN 'A' WHEN 'boundary_drift' THEN 'D' WHEN 'cross_boundary_token' THEN 'X' "
              "WHEN 'partial_target_truncation' THEN 'P' WHEN 'target_eliminated' THEN 'E' ELSE '?' END || ' ' || kept_n || '/' || full_n")
    out["retention_matrix"] = _report(
        "SELECT case_id, " + ", ".join(f"max(CASE WHEN max_length = {n} THEN {letter} END) AS len_{n}" for n in (64, 128, 256, 512)) +
        " FROM reports GROUP BY 1", sweep)
    return out
