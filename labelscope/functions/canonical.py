"""Canonical JSON text and content hashes, all on the JVM.

``to_json`` emits compact JSON with fields in declared order, so structs that
declare theirs alphabetically are canonical but for the spelling of escapes. A
Python helper here would also make the optimizer inline every projection below.
"""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscope.functions.arrays import let

#: Distinct characters that are escaped one after the other; texts with more are taken apart.
FEW = 32
NULLS = {"ignoreNullFields": "false"}
# One JSON escape, one non-ASCII code point, or a run of plain ASCII.
_TOKENS = r"\\u[0-9A-Fa-f]{4}|\\.|[^\x{00}-\x{7F}]|[\x{00}-\x{5B}\x{5D}-\x{7F}]+"


def _unit(value: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(value), 4, "0")))


def _escaped(char: Column) -> Column:
    """``\\uXXXX`` form of one code point, as a surrogate pair past U+FFFF."""
    point = F.ascii(char)
    above = point - 0x10000
    pair = F.concat(_unit(F.shiftright(above, 10) + 0xD800), _unit(above.bitwiseAND(0x3FF) + 0xDC00))
    return F.when(point > 0xFFFF, pair).otherwise(_unit(point))


def canonical_json(value: Column, ascii_only: bool = False) -> Column:
    """Sorted, compact JSON; ``value`` must declare its fields alphabetically."""
    odd_pattern = r"\\u|[^\x{00}-\x{7F}]" if ascii_only else r"\\u"

    def token(t: Column) -> Column:
        lowered = F.when(t.startswith("\\u"), F.lower(t))
        return (lowered.when(t.rlike(r"[^\x{00}-\x{7F}]"), _escaped(t)) if ascii_only else lowered).otherwise(t)

    def rewrite(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
        by_token = F.when(text.rlike(odd_pattern), F.array_join(F.transform(tokens, token), "")).otherwise(text)
        if not ascii_only:
            return by_token
        # Without escapes of control characters only the odd characters change: each of a few is replaced at once, everywhere.
        odd = F.when(~text.contains("\\u"), F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x{00}-\x{7F}]"), F.lit(0))))
        replaced = let(odd, lambda chars: F.when(F.size(chars) <= FEW, F.aggregate(
            chars, text, lambda done, c: F.replace(done, c, _escaped(c)))).otherwise(by_token))
        # Most texts have nothing to change, which their size says without a pattern.
        return F.when((F.octet_length(text) == F.char_length(text)) & ~text.contains("\\u"), text).otherwise(replaced)

    return let(F.to_json(value, NULLS), rewrite)


def json_object(fields: Mapping[str, Column]) -> Column:
    """An object of members whose canonical JSON is at hand, by name; a NULL one is null."""
    members = [part for name in sorted(fields) for part in (F.lit(f',"{name}":'), F.coalesce(fields[name], F.lit("null")))]
    members[0] = F.lit("{" + f'"{min(fields)}":')
    return F.concat(*members, F.lit("}"))


def line_sha256(text: Column) -> Column:
    """SHA-256 of the text followed by one newline."""
    return F.sha2(F.concat(text, F.lit("\n")), 256)


def labels_sha256(labels: Column) -> Column:
    return line_sha256(F.concat(F.lit("["), F.array_join(labels.cast("array<string>"), ","), F.lit("]")))


def git_blob_sha1(content: Column) -> Column:
    """Git object id of a blob holding the binary ``content``."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), content))


def line_count(content: Column) -> Column:
    """Lines of binary ``content``; CR, LF and CRLF each end one line."""
    text = F.decode(content, "ISO-8859-1")
    ends = F.regexp_count(text, F.lit(r"\r\n|\n|\r"))
    open_line = F.when(text.rlike(r"[^\r\n]\z"), 1).otherwise(0)
    return (ends + open_line).cast("bigint")
