"""Exact merge-type subword encoding by backtracking, and decoding.

A piece model of merge type (BPE by scores) is encoded without replaying merges:
Aho-Corasick gives the longest piece at every place, two neighbours are
compatible when merging their joined text again yields just these two, and a
bitfield marks places from which no encoding goes on. Backtracking from the
longest match finds the one encoding whose neighbours are all compatible, which
is the one that merging gives.

Text is cut where no piece reaches across: before blanks and between characters
that never stand side by side inside a piece. Merges cannot cross such a cut, so
parts are encoded on their own and kept in a bounded table.

Defined results: NULL is the empty text, which has the begin and end ids alone;
characters outside the vocabulary become byte pieces; very long texts without
blanks are encoded whole; repeated rows are encoded alike.
"""

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import kept, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@dataclass
class PieceModel:
    """Vocabulary of a merge-type model with byte fallback."""

    pieces: list[str]  # mergeable pieces by number
    ids: list[int]  # their ids
    scores: list[float]
    byte_ids: list[int]
    bos: int
    eos: int
    number: dict[str, int] = field(init=False)
    sizes: list[int] = field(init=False)
    shorter: list[int] = field(init=False)  # longest piece that is a proper prefix, or -1
    automaton: ahocorasick.Automaton = field(init=False)
    inner: frozenset[str] = field(init=False)
    compatible: dict[tuple[int, int], bool] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.sizes = [len(p) for p in self.pieces]
        # Pieces that merging their own text does not give are never met.
        reachable = [len(p) == 1 or self.merged(p) == [p] for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.pieces)
        inner = set()
        for i, piece in enumerate(self.pieces):
            inner.update(piece[k:k + 2] for k in range(len(piece) - 1))
            if reachable[i]:
                self.automaton.add_word(piece, (i, len(piece)))
                self.shorter[i] = next((n for k in range(len(piece) - 1, 0, -1)
                                        if (n := self.number.get(piece[:k], -1)) >= 0 and reachable[n]), -1)
        self.automaton.make_automaton()
        self.inner = frozenset(inner)

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(lib.get_piece_size())]
        ids = [i for i, s in enumerate(special) if not s]
        return cls([lib.id_to_piece(i) for i in ids], ids, [lib.get_score(i) for i in ids],
                   [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], lib.bos_id(), lib.eos_id())

    def merged(self, text: str) -> list[str]:
        """Merging by definition: best score first, leftmost among equals. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                n = self.number.get(parts[k] + parts[k + 1])
                if n is not None and (best is None or self.scores[n] > best):
                    best, at = self.scores[n], k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def joins(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their text is merged again."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.compatible[left, right] = a[-1] + b[0] not in self.inner or self.merged(a + b) == [a, b]
        return known

    def encode_part(self, text: str) -> list[int]:
        """Ids of a part, by backtracking; characters without a piece fall back to bytes."""
        longest = [-1] * len(text)
        for end, (n, size) in self.automaton.iter(text):
            longest[end - size + 1] = n  # ends grow, so the last piece met at a place is its longest
        if -1 not in longest:
            return self._search(longest, 0, len(text))
        out: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:
                out.extend(self.byte_ids[b] for b in text[at].encode())
                at += 1
                continue
            stop = at
            while stop < len(text) and longest[stop] >= 0:
                stop += 1
            out += self._search(longest, at, stop)
            at = stop
        return out

    def _search(self, longest: list[int], start: int, stop: int) -> list[int]:
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        chosen: list[int] = []
        dead: bytearray | None = None  # a bit for each place: nothing goes on from here
        at, offer, last = start, longest[start], -1
        while at < stop:
            while offer >= 0:
                end = at + sizes[offer]
                if end <= stop and (dead is None or not dead[(end - start) >> 3] >> ((end - start) & 7) & 1) and (
                        last < 0 or (compatible[last, offer] if (last, offer) in compatible else self.joins(last, offer))):
                    break
                offer = shorter[offer]
            if offer >= 0:
                chosen.append(offer)
                at, last = end, offer
                offer = longest[at] if at < stop else -1
            else:
                if not chosen:
                    raise ValueError("the vocabulary cannot spell this text")
                dead = bytearray((stop - start) // 8 + 1) if dead is None else dead
                dead[(at - start) >> 3] |= 1 << ((at - start) & 7)
                offer = chosen.pop()
                at -= sizes[offer]
                offer, last = shorter[offer], chosen[-1] if chosen else -1
        return [self.ids[n] for n in chosen]


#: Latin letters; a vocabulary that joins one to another kind of character is cut more coarsely.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"


class Encoder:
    """Whole texts to ids, with a bounded table of parts."""

    def __init__(self, model: PieceModel, limit: int = 500_000):
        self.model, self.limit = model, limit
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in model.pieces):
            raise ValueError("a piece holds a blank after another character, or a line end")
        letter = re.compile(f"[{_LETTER}]")
        mixed = any(BLANK not in pair and bool(letter.match(pair[0])) != bool(letter.match(pair[1])) for pair in model.inner)
        self.parts = re.compile(rf"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+" if mixed else
                                rf"{BLANK}*[{_LETTER}]+|{BLANK}*[^{_LETTER}{BLANK}\n]+|\n|{BLANK}+").findall
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids, with begin and end."""
        ends = np.array([self.model.bos, self.model.eos], "<u4").tobytes()
        if not text:
            return ends
        found = self.parts(BLANK + text.replace(" ", BLANK))
        known = self.known
        new = set(found).difference(known)
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(found)
            for part in new:
                known[part] = struct.pack(f"<{len(ids)}I", *ids) if (ids := self._part(part)) else b""
        return b"".join([ends[:4], *map(known.__getitem__, found), ends[4:]])

    def _part(self, part: str) -> list[int]:
        inner, start, out = self.model.inner, 0, []
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1:k + 1] not in inner:
                out += self.model.encode_part(part[start:k])
                start = k
        return out


def encode(texts: Iterator[pd.Series], path: str = MODEL) -> Iterator[pd.Series]:
    """Batches of texts to batches of packed ids."""
    encoder = kept(("pieces", path), lambda: Encoder(PieceModel.load(path)))
    for part in texts:
        yield pd.Series([encoder.ids(t or "") for t in part.tolist()])


def decode(packed: bytes, lib: sentencepiece.SentencePieceProcessor) -> str:
    return lib.decode(np.frombuffer(packed, "<u4").tolist())


def encode_column(text: Column, path: str = MODEL) -> Column:
    """Packed little-endian 32-bit ids of a text column."""
    return _over(lambda parts: encode(parts, path), "binary", pd.Series)(text)


def digests_column(text: Column, path: str = MODEL) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [c.split()[0] for c in RESULT.split(", ")]
        for packed in encode(parts, path):
            yield pd.DataFrame([
                (len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(decode(p, lib).encode()).hexdigest())
                for p in packed], columns=names)

    return _over(run, RESULT, pd.DataFrame)(text)


def _over(run: Callable, result: str, kind: type):
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[kind]}
    return F.pandas_udf(run, result).asNondeterministic()


def op2_piece_encoding(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again, as digests."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests_column(F.col("text")).alias("_d")).select("doc_id", "_d.*")
