"""Hash of JSON by meaning: key order, spacing and number spelling do not count."""

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from labelscope.functions.strict_json import is_plain


class _Duplicate(ValueError):
    pass


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Duplicate
    return out


def _non_finite(_):
    raise ValueError


def _number(value: Decimal) -> str:
    if not value:
        return "0"
    short = value.normalize()
    if abs(short) >= Decimal("1e9"):
        return f"{short:E}"
    return f"{short:f}"


def _render(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_render(k)}:{_render(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_render, value)) + "]"
    if isinstance(value, Decimal):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def semantic_form(text: str | None) -> str | None:
    """Canonical text, or None when the JSON is not acceptable."""
    if text is None:
        return None
    try:
        return _render(json.loads(
            text, object_pairs_hook=_unique, parse_int=Decimal, parse_float=Decimal, parse_constant=_non_finite))
    except (ValueError, RecursionError):
        return None


@pandas_udf(T.StringType())
def _forms(texts: pd.Series) -> pd.Series:
    return texts.map(semantic_form)


#: Levels of nesting that the JVM canonicalizes; deeper documents go to the helper.
JVM_DEPTH = 12


def semantic_json_sha256(text: Column) -> Column:
    """SHA-256 of the canonical line of each JSON text, NULL when it is not acceptable.

    A variant keeps its keys in order and prints compactly, which is the canonical
    form of ASCII text without escapes, fractions, exponents, negative zeros or
    numbers of ten digits. Other documents are rendered in the helper.
    """
    simple = is_plain(text, JVM_DEPTH) & ~text.contains("\\") & (F.octet_length(text) == F.char_length(text))
    form = F.when(simple, F.to_json(F.try_parse_json(text))).otherwise(_forms(F.when(~simple, text)))
    return F.sha2(F.concat(form, F.lit("\n")), 256)
