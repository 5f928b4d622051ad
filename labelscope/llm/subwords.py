"""Whole texts to ids with a public tokenizer, through a bounded table of its words.

Both public files split a text into words before any merge. Over ASCII and Latin
letters that split is one short expression, so the library encodes each distinct
word once; a text with any other character goes to the library whole. Ids equal
``encode(text, add_special_tokens=False)`` either way.
"""

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from labelscope.llm.common import kept

#: U+0130 is left out, since its lower case ends in a mark.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_REGULAR = re.compile(rf"[{_LETTER}\t-\r -~]*\Z")
#: The expressions by which the two files split, over these characters,
#: with letters first, which begin no other alternative.
_WITH_BLANKS = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_WITHOUT = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{_LETTER}0-9]+")
_LETTERS = re.compile(rf" ?[{_LETTER}]+\Z")


class CachedTokenizer:
    """Packed little-endian 32-bit ids of texts."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.blanks = ids(" a") != ids("a")  # else white space goes and case is folded
        self.words = (_WITH_BLANKS if self.blanks else _WITHOUT).findall
        # What closes a word in a list of words: a line end of its own, or the word's last piece.
        self.closing = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.closing[ids("\n") if self.blanks else [i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        # The words met lately, and those of before, which come back when they are met.
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text, and ``end`` after them."""
        split = [self._split(t) for t in texts]
        out, missing, new = [], [], set()
        for words in split:
            found = list(map(self.known.get, words or ()))
            holes, at = [], -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                word = words[at]
                if (seen := self.older.get(word)) is not None:
                    self.known[word] = found[at] = seen
                else:
                    holes.append(at)
                    new.add(word)
            out.append(found)
            missing.append(holes)
        self._learn(list(new))
        for text, words, found, holes in zip(texts, split, out, missing, strict=True):
            for i in holes:
                found[i] = self.known[words[i]]
            if words is None:
                found.append(self._whole(text))
            found.append(end)
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}
        return list(map(b"".join, out))

    def _split(self, text: str) -> list[str] | None:
        if not _REGULAR.match(text) or any(s in text for s in self.special):
            return None
        return self.words(text if self.blanks else text.lower())

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if _LETTERS.match(w)]
        for at in range(0, len(letters), 512):
            self._together(letters[at:at + 512])
        for word in new:
            if word not in self.known:
                self.known[word] = self._whole(word)

    def _together(self, words: list[str]) -> None:
        """Words in one text, one a line; left out if the ids don't fall apart again."""
        text = "\n".join(words) + "\n" * self.blanks
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closing[ids])
        if len(ends) != len(words) or ends[-1] != len(ids) - 1:
            return
        raw, own = ids.tobytes(), 4 * (not self.blanks)
        stops = (4 * ends).tolist()
        self.known.update(zip(words, [raw[a:b + own] for a, b in zip([0, *(x + 4 for x in stops)], stops)]))


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int = 600_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with the packed ids of their ``text``, each closed by ``end_id``."""
    tokenizer = kept(("subwords", path), lambda: CachedTokenizer(path, limit))
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            yield some, tokenizer.encode_batch([t or "" for t in some["text"].to_pylist()], end)
