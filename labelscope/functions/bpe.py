"""Byte-pair pieces and ids as Spark expressions."""

import heapq
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from labelscope.functions.arrays import empty, int_range, let

#: Up to so many merges or pieces an expression spells them out; beyond, a broadcast
#: table serves an Arrow function. Both give the same pieces and ids.
EXPRESSION_LIMIT = 64
#: Distinct chunks whose pieces a task keeps.
CHUNK_TABLE = 200_000
PRIVATE_USE = 0xE000

# --- fixed values: the pinned 15-piece vocabulary and its one merge ---------
PINNED_VOCAB = {
    "<unk>": 0, "<bos>": 1, " ": 2, "a": 3, "b": 4, "c": 5, "d": 6, "e": 7,
    "f": 8, "g": 9, "h": 10, "i": 11, "x": 12, "é": 13, "ab": 14,
}
PINNED_MERGES = (("a", "b"),)
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class BpeTokenizer:
    """A merge table over code points, with no pre-tokenizer or byte fallback.

    ``codepoint_base`` gives every single code point the id ``base + code point``
    when the vocabulary does not list it, so open text has no unknowns.
    """

    vocab: Mapping[str, int] = field(default_factory=lambda: dict(PINNED_VOCAB))
    merges: tuple[tuple[str, str], ...] = PINNED_MERGES
    codepoint_base: int | None = None
    unknown_id: int = 0
    unknown_piece: str = "<unk>"
    bos_id: int = 1
    bos_piece: str = "<bos>"

    def __post_init__(self):
        built: set[str] = set()
        for left, right in self.merges:
            for part in (left, right):
                if len(part) > 1 and part not in built:
                    raise ValueError("a merge uses a piece that no earlier merge builds")
            if left + right in built or left + right not in self.vocab:
                raise ValueError("each merge must build one new vocabulary piece")
            built.add(left + right)

    def pieces(self, text: Column) -> Column:
        """Pieces of ``text`` before unknown ones are replaced, lowest rank first.

        In a short table each rank folds its pair into one private-use code point,
        so a merge is one literal replacement over the whole text and the rest is a
        split into code points; texts that already use those code points are marked
        instead. A longer table is broadcast and merged by rank per distinct chunk.
        """
        last = PRIVATE_USE + len(self.merges) - 1
        if len(self.merges) > EXPRESSION_LIMIT:
            return _ranked_pieces(self.merges)(text)
        if not self.merges:
            pieces = F.split(text, "")
        else:
            reserved = (F.octet_length(text) != F.char_length(text)) & text.rlike(f"[\\x{{{PRIVATE_USE:X}}}-\\x{{{last:X}}}]")
            pieces = F.when(reserved, self._marked_pieces(text)).otherwise(self._folded_pieces(text))
        return F.when(F.length(text) == 0, empty("string")).otherwise(pieces)

    def _folded_pieces(self, text: Column) -> Column:
        code: dict[str, str] = {}
        folded = text
        for rank, (left, right) in enumerate(self.merges):
            merged = chr(PRIVATE_USE + rank)
            folded = F.replace(folded, F.lit(code.get(left, left) + code.get(right, right)), F.lit(merged))
            code[left + right] = merged
        spelled = F.array(*[F.lit(left + right) for left, right in self.merges])
        low, high = chr(PRIVATE_USE), chr(PRIVATE_USE + len(self.merges) - 1)
        return F.transform(
            F.split(folded, ""),
            lambda p: F.when(p.between(low, high), F.get(spelled, F.ascii(p) - PRIVATE_USE)).otherwise(p))

    def _marked_pieces(self, text: Column) -> Column:
        """The same with every piece kept between two NULs, which no text holds."""
        nul = "\x00"
        marked = F.regexp_replace(text, "(?s)(.)", f"{nul}$1{nul}")
        for left, right in self.merges:
            marked = F.replace(
                marked,
                F.lit(f"{nul}{left}{nul}{nul}{right}{nul}"),
                F.lit(f"{nul}{left}{right}{nul}"),
            )
        return let(marked, lambda m: F.split(F.substring(m, F.lit(2), F.length(m) - 2), f"{nul}{nul}"))

    def ids(self, pieces: Column) -> Column:
        """Vocabulary id of every piece."""
        if len(self.vocab) > EXPRESSION_LIMIT:
            known = _dictionary_lookup(dict(self.vocab))(pieces)
            return F.zip_with(known, pieces, lambda i, p: F.coalesce(i, self._unlisted(p)))
        table = F.create_map(*[F.lit(x) for item in self.vocab.items() for x in item])
        listed = lambda p: F.coalesce(F.try_element_at(table, p).cast("bigint"), self._unlisted(p))
        if self.codepoint_base is None or any(len(p) == 1 for p in self.vocab):
            return F.transform(pieces, listed)
        # Only merged pieces are listed, so single code points skip the table.
        return F.transform(pieces, lambda p: F.when(F.char_length(p) == 1, self._unlisted(p)).otherwise(listed(p)))

    def _unlisted(self, piece: Column) -> Column:
        unknown = F.lit(self.unknown_id).cast("bigint")
        if self.codepoint_base is None:
            return unknown
        point = F.ascii(piece).cast("bigint") + F.lit(self.codepoint_base)
        return F.when(F.char_length(piece) == 1, point).otherwise(unknown)

    def shown(self, ids: Column, pieces: Column) -> Column:
        """Pieces as an encoding reports them: unknown ones by the unknown piece."""
        replaced = F.zip_with(
            ids, pieces, lambda i, p: F.when(i == self.unknown_id, F.lit(self.unknown_piece)).otherwise(p))
        return F.when(F.array_contains(ids, F.lit(self.unknown_id).cast("bigint")), replaced).otherwise(pieces)


def _shared(value):
    """``value`` sent once to each executor."""
    return SparkSession.active().sparkContext.broadcast(value)


def _dictionary_lookup(vocab: dict[str, int]):
    shared = _shared(vocab)

    @pandas_udf(T.ArrayType(T.LongType()))
    def lookup(rows: pd.Series) -> pd.Series:
        table = shared.value
        flat = [p for row in rows if row is not None for p in row]
        codes, distinct = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, int), [])
        found = np.array([table.get(p) for p in distinct], object)[codes] if flat else codes
        ends = np.cumsum([0 if row is None else len(row) for row in rows])
        return pd.Series([None if row is None else found[end - len(row):end] for row, end in zip(rows, ends, strict=True)], dtype=object)

    return lookup


def merge_by_rank(text: str, ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """Pieces of a chunk: the lowest-ranked neighbouring pair first, leftmost among equals."""
    pieces: list[str | None] = list(text)
    after, before = list(range(1, len(pieces) + 1)), list(range(-1, len(pieces) - 1))
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)) if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if pieces[i] != left or j >= len(pieces) or pieces[j] != right:
            continue  # one of the two has been merged meanwhile
        pieces[i], pieces[j] = left + right, None
        after[i] = k = after[j]
        if k < len(pieces):
            before[k] = i
            if (rank := ranks.get((pieces[i], pieces[k]))) is not None:
                heapq.heappush(heap, (rank, i, pieces[i], pieces[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get((pieces[h], pieces[i]))) is not None:
            heapq.heappush(heap, (rank, h, pieces[h], pieces[i]))
    return [p for p in pieces if p is not None]


def _ranked_pieces(merges: tuple[tuple[str, str], ...]):
    shared = _shared({pair: rank for rank, pair in enumerate(merges)})
    # Where no merge joins white space to anything else, words are chunks of their own.
    split = not any(bool(re.search(r"\s", a + b)) and bool(re.search(r"\S", a + b)) for a, b in merges)
    chunks = re.compile(r"\s+|\S+" if split else r"(?s).+").findall

    @pandas_udf(T.ArrayType(T.StringType()))
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, known = shared.value, {}
        for rows in parts:
            out = []
            for text in rows:
                found: list[str] = []
                for chunk in chunks(text or ""):
                    if chunk not in known:
                        if len(known) >= CHUNK_TABLE:
                            known.clear()
                        known[chunk] = merge_by_rank(chunk, ranks)
                    found += known[chunk]
                out.append(None if text is None else found)
            yield pd.Series(out, dtype=object)

    return pieces


def pinned_tokenizer() -> BpeTokenizer:
    return BpeTokenizer()


def open_text_tokenizer(merges: tuple[tuple[str, str], ...] = PINNED_MERGES, base: int = 1024) -> BpeTokenizer:
    """Merges over any text: code points by rule, merged pieces from id 2 up."""
    vocab = {"<unk>": 0, "<bos>": 1}
    vocab.update({left + right: rank + 2 for rank, (left, right) in enumerate(merges)})
    return BpeTokenizer(vocab=vocab, merges=tuple(merges), codepoint_base=base)


def char_spans(pieces: Column) -> Column:
    """Half-open code-point span of every (non-empty) piece in their concatenation."""
    lengths = F.transform(pieces, lambda p: F.char_length(p))

    def spans(sizes: Column) -> Column:
        # Whether a character begins a piece; most pieces are one.
        opens = F.flatten(F.transform(sizes, lambda n: F.when(n == 1, F.array(F.lit(True))).when(
            n == 0, empty("boolean")).otherwise(F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), n - 1)))))
        starts = let(opens, lambda o: F.filter(int_range(0, F.size(o)), lambda j: F.get(o, j)))
        return let(starts, lambda at: F.arrays_zip(at.alias("start"), F.zip_with(at, sizes, lambda s, n: s + n).alias("end")))

    return let(lengths, spans)


def raw_offsets(spans: Column, offsets: Column) -> Column:
    """Reported offset of every normalized span; NULL ``offsets`` means identity."""
    moved = let(offsets, lambda at: F.transform(spans, lambda s: F.struct(
        F.get(at, s["start"]).alias("start"), (F.get(at, s["end"] - 1) + 1).alias("end"))))
    return F.when(offsets.isNull(), spans).otherwise(moved)


VECTORS = ("ids", "pieces", "offsets", "type_ids", "special_tokens_mask", "attention_mask")


def with_pieces(df: DataFrame, tokenizer: BpeTokenizer, names: tuple[str, ...]) -> DataFrame:
    """Adds ``{name}_raw``, ``{name}_ids`` and ``{name}_spans`` of ``{name}_encoder_text``."""
    out = df.withColumns({f"{n}_raw": tokenizer.pieces(F.col(f"{n}_encoder_text")) for n in names})
    columns = {}
    for n in names:
        columns[f"{n}_ids"] = tokenizer.ids(F.col(f"{n}_raw"))
        columns[f"{n}_spans"] = char_spans(F.col(f"{n}_raw"))
    return out.withColumns(columns)


def with_vectors(df: DataFrame, tokenizer: BpeTokenizer, names: Mapping[str, str]) -> DataFrame:
    """Adds the six vectors ``{output}__*``, prefix token included; ``names`` maps text to output.

    Vectors stay flat columns until a report is built: the optimizer would copy
    a struct's field expressions to every place that reads one.
    """
    origin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    columns = {}
    for text, n in names.items():
        raw, ids = F.col(f"{text}_raw"), F.col(f"{text}_ids")
        columns |= {
            f"{n}__ids": F.concat(F.array(F.lit(tokenizer.bos_id).cast("bigint")), ids),
            f"{n}__pieces": F.concat(F.array(F.lit(tokenizer.bos_piece)), tokenizer.shown(ids, raw)),
            f"{n}__offsets": F.concat(
                F.array(origin), raw_offsets(F.col(f"{text}_spans"), F.col(f"{text}_origin_offsets"))),
            f"{n}__type_ids": F.array_repeat(F.lit(0), F.size(raw) + 1),
            f"{n}__special_tokens_mask": F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size(raw))),
            f"{n}__attention_mask": F.array_repeat(F.lit(1), F.size(raw) + 1),
        }
    return df.withColumns(columns)


def with_truncations(df: DataFrame, names: Mapping[str, str], max_length: Column) -> DataFrame:
    """Adds the first ``max_length`` positions of every vector; ``names`` maps full to truncated."""
    return df.withColumns({
        f"{cut}__{v}": F.slice(f"{full}__{v}", F.lit(1), max_length) for full, cut in names.items() for v in VECTORS
    })


def exact_prefix(full: str, truncated: str) -> Column:
    """All six vectors of ``truncated`` equal the head of those of ``full``."""
    size = F.size(f"{truncated}__ids")
    same = size <= F.size(f"{full}__ids")
    for v in VECTORS:
        same = same & (F.slice(f"{full}__{v}", F.lit(1), size) == F.col(f"{truncated}__{v}"))
    return same


def as_struct(name: str) -> Column:
    """The report form: fields in alphabetical order, offsets as pairs."""
    c = lambda v: F.col(f"{name}__{v}")
    pairs = F.transform(c("offsets"), lambda o: F.array(o["start"], o["end"]))
    return F.struct(
        c("attention_mask").alias("attention_mask"), c("ids").alias("ids"), pairs.alias("offsets"),
        c("pieces").alias("pieces"), c("special_tokens_mask").alias("special_tokens_mask"),
        c("type_ids").alias("type_ids"),
    ).alias(name)


def from_struct(df: DataFrame, name: str) -> DataFrame:
    """Flatten a supplied encoding column (see ``schemas.ENCODING``) into ``{name}__*``."""
    offsets = F.transform(
        F.col(f"{name}.offsets"), lambda o: F.struct(F.get(o, F.lit(0)).alias("start"), F.get(o, F.lit(1)).alias("end")))
    columns = {f"{name}__{v}": F.col(f"{name}.{v}") for v in VECTORS}
    return df.withColumns({**columns, f"{name}__offsets": offsets}).drop(name)
