"""NFC with per-character provenance.

Spark has no NFC function, so texts that NFC could change go through a
vectorized helper. A text made only of *inert* code points (combining class 0,
already NFC, never composing with a neighbour) is its own NFC form with
identity provenance; those rows enter the helper as NULL and stay on the JVM.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from labelscope.functions import text as text_fns

# --- fixed values: ranges of inert code points ------------------------------
INERT_RANGES = (
    (0x0001, 0x02FF),
    (0x0391, 0x03A1), (0x03A3, 0x03CE),
    (0x0400, 0x0482), (0x048A, 0x052F),
    (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF),
    (0x2190, 0x21FF), (0x2500, 0x27BF),
    (0x3001, 0x3029), (0x3041, 0x3096), (0x309D, 0x30FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF60),
    (0x1F300, 0x1F64F), (0x1F680, 0x1F6C5), (0x1F900, 0x1F9FF),
)
# --- end of fixed values ----------------------------------------------------

#: Characters whose provenance a worker holds at once.
HELD_CHARS = 1 << 18
#: Index arrays leave the helper as runs of neighbouring values: where each begins, and how long it is.
_INDEXES = ("starts", "ends", "offsets")
_RUNS = [T.StructField(f"{name}_{part}", T.ArrayType(T.IntegerType())) for name in _INDEXES for part in ("first", "size")]
_REPLAY_TYPE = T.StructType([
    T.StructField("nfc", T.StringType()),
    *_RUNS,
    T.StructField("replay_ok", T.BooleanType()),
    T.StructField("ambiguous", T.BooleanType()),
])


def _inert_class() -> str:
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in INERT_RANGES)


def may_change(text: Column) -> Column:
    """True unless every code point is inert."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return ~ascii_only & text.rlike(f"[^{_inert_class()}]")


@pandas_udf(T.StringType())
def _nfc_series(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc_series(F.when(may_change(text), text)), text)


def _origins(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Clusterwise NFC of ``text`` with the raw interval ``[start, end)`` of each code point, -1 when unknown.

    A cluster is a code point of combining class 0 with the marks after it. One
    that becomes a single code point gives it the whole cluster; one that NFC
    leaves alone, mark by mark, maps one to one; any other is unknown.
    """
    opens = np.flatnonzero([at == 0 or unicodedata.combining(c) == 0 for at, c in enumerate(text)])
    closes = np.append(opens[1:], len(text))
    parts = [text[a:b] for a, b in zip(opens, closes, strict=True)]
    forms = [unicodedata.normalize("NFC", p) for p in parts]
    sizes = np.array([len(f) for f in forms], int)
    kept = np.array([f == p and all(map(_alone, p)) for f, p in zip(forms, parts, strict=True)], bool)
    cluster = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(cluster)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = (sizes == 1)[cluster]
    each = kept[cluster] & ~whole
    start = np.where(whole, opens[cluster], np.where(each, opens[cluster] + inside, -1))
    end = np.where(whole, closes[cluster], np.where(each, start + 1, -1))
    return "".join(forms), start, end


def _alone(char: str) -> bool:
    return unicodedata.is_normalized("NFC", char)


@lru_cache(maxsize=1)
def _joins_previous() -> frozenset:
    """Combining-class-0 code points that can compose with the one before."""
    found = set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3)))
    for point in range(0x300, 0x20000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            tail = chr(int(parts[1], 16))
            if not unicodedata.combining(tail):
                found.add(tail)
    return frozenset(found)


def _encoder_offsets(text: str) -> list[int]:
    """Raw index an encoder reports for each NFC code point.

    Within a composing group the first output keeps the group's first index;
    code points lost to composition follow it, and ones gained share it.
    """
    joins = _joins_previous()
    offsets: list[int] = []
    opened = 0
    for at in range(1, len(text) + 1):
        if at < len(text) and (unicodedata.combining(text[at]) or text[at] in joins):
            continue
        raw_size = at - opened
        size = len(unicodedata.normalize("NFC", text[opened:at]))
        offsets.append(opened)
        offsets.extend(opened + max(0, raw_size - size + i) for i in range(1, size))
        opened = at
    return offsets


def _runs(values: np.ndarray) -> tuple[list, list]:
    """Runs of values that grow by one, or are unknown (-1): what each begins with, None when unknown, and its size."""
    if not len(values):
        return [], []
    unknown = values < 0
    goes_on = np.where(unknown[1:], unknown[:-1], ~unknown[:-1] & (values[1:] == values[:-1] + 1))
    first = np.flatnonzero(np.append(True, ~goes_on))
    sizes = np.diff(np.append(first, len(values)))
    return [v if v >= 0 else None for v in values[first].tolist()], sizes.tolist()


def _replay_one(text: str | None):
    if text is None:
        return (None,) * len(_REPLAY_TYPE)
    whole = unicodedata.normalize("NFC", text)
    form, start, end = _origins(text)
    same = form == whole
    ambiguous = same and bool((start < 0).any())
    if not same:
        start = end = np.full(len(whole), -1)
    return (whole, *_runs(start), *_runs(end), *_runs(np.array(_encoder_offsets(text), int)), same, ambiguous)


@pandas_udf(_REPLAY_TYPE)
def _replay(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        for part in _few(texts):
            yield pd.DataFrame([_replay_one(t) for t in part], columns=_REPLAY_TYPE.fieldNames(), dtype="object")


def _few(texts: pd.Series) -> Iterator[pd.Series]:
    """Runs of ``texts`` of ``HELD_CHARS`` characters or one longer text: a character's provenance takes hundreds of bytes."""
    lot = np.cumsum([0 if t is None else len(t) for t in texts]) // HELD_CHARS
    cuts = [0, *(np.flatnonzero(lot[1:] != lot[:-1]) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.iloc[a:b]


def _unrolled(replayed: Column, name: str) -> Column:
    """The index array that the runs of ``name`` stand for."""
    each = F.zip_with(replayed[f"{name}_first"], replayed[f"{name}_size"], lambda first, size: F.when(
        first.isNull(), F.array_repeat(F.lit(None).cast("int"), size)).otherwise(F.sequence(first, first + size - 1)))
    return F.flatten(each)


def replay(text: Column) -> Column:
    """Provenance struct; every field is NULL for inert texts (identity)."""
    return _replay(F.when(may_change(text), text))


def with_normalization(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds flat ``{name}_*`` columns: normalized forms, counts and provenance.

    ``{name}_starts``, ``{name}_ends`` and ``{name}_origin_offsets`` are NULL
    where provenance is the identity. All names share each projection.
    """
    out = df.withColumns({f"_{n}_replay": replay(F.col(n)) for n in names})
    out = out.withColumns({f"_{n}_nfc": F.coalesce(F.col(f"_{n}_replay.nfc"), F.col(n)) for n in names})
    columns = {}
    for n in names:
        replayed = F.col(f"_{n}_replay")
        replay_ok = F.coalesce(replayed["replay_ok"], F.lit(True))
        ambiguous = F.coalesce(replayed["ambiguous"], F.lit(False))
        columns |= {
            f"{n}_normalized": text_fns.right_strip(F.col(f"_{n}_nfc")),
            f"{n}_encoder_text": text_fns.encoder_strip(F.col(f"_{n}_nfc")),
            f"{n}_raw_count": F.char_length(n),
            f"{n}_nfc_count": F.char_length(f"_{n}_nfc"),
            f"{n}_starts": _unrolled(replayed, "starts"),
            f"{n}_ends": _unrolled(replayed, "ends"),
            f"{n}_origin_offsets": _unrolled(replayed, "offsets"),
            f"{n}_complete": replay_ok & ~ambiguous,
            f"{n}_norm_reasons": F.when(~replay_ok, F.array(F.lit("normalization.cluster_replay")))
            .when(ambiguous, F.array(F.lit("normalization.provenance_ambiguous")))
            .otherwise(F.array().cast("array<string>")),
        }
    drop = [f"_{n}_{part}" for n in names for part in ("replay", "nfc")]
    return out.withColumns(columns).drop(*drop)
