"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds those over
capacity / (k + 1) and up to capacity / k, and a bin of class k takes k of them.
Workers pack on their own: a task keeps one open bin a class and no row moves.
Since a document may be cut, the slack of a filled bin is closed with the head
of the next document, so that bins leave full; a document over the capacity
gives whole sequences first. What is open when a task's rows end is chained into
full sequences, and the last one falls into powers of two, which need no padding.

Defined results: a NULL or empty text is the end id alone; repeated rows are
documents of their own; an empty table gives no pieces. Sequence ids are unique
across tasks and the same when a lost task runs again on the same rows.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from labelscope.llm.common import table
from labelscope.llm.subwords import tokenized

CAPACITY = 4096
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one task; ids of tasks lie this far apart.
SEQUENCES_PER_TASK = 1 << 33
_ROWS = 20_000


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def split(self, at: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:at]),
                Piece(self.doc_id, self.start + at, self.doc_tokens, self.ids[at:]))


@dataclass
class Bin:
    pieces: list[Piece] = field(default_factory=list)
    total: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.total += len(piece.ids)


class Packer:
    """The bins of one worker; ``add`` and ``finish`` yield full sequences."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.classes: dict[int, Bin] = {}
        self.slack: Bin | None = None  # has its count of documents, but room left

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        rest = Piece(doc_id, 0, len(ids), ids)
        if self.slack and len(rest.ids):
            head, rest = rest.split(min(self.capacity - self.slack.total, len(rest.ids)))
            self.slack.add(head)
            if self.slack.total == self.capacity:
                yield self.slack.pieces
                self.slack = None
        while len(rest.ids) >= self.capacity:
            head, rest = rest.split(self.capacity)
            yield [head]
        if not len(rest.ids):
            return
        k = self.capacity // len(rest.ids)
        box = self.classes.setdefault(k, Bin())
        box.add(rest)
        if len(box.pieces) == k:
            del self.classes[k]
            if box.total == self.capacity:
                yield box.pieces
            else:  # the last slack is closed: this document's head went there
                self.slack = box

    def finish(self) -> Iterator[list[Piece]]:
        left = [p for box in (self.slack, *map(self.classes.get, sorted(self.classes))) if box for p in box.pieces]
        self.slack, self.classes = None, {}
        remaining = sum(len(p.ids) for p in left)
        left.reverse()
        while left:
            # Whole sequences, then ever smaller powers of two.
            room = self.capacity if remaining >= self.capacity else 1 << (remaining.bit_length() - 1)
            remaining -= room
            box = Bin()
            while box.total < room:
                head, rest = left.pop().split(room - box.total)
                box.add(head)
                if len(rest.ids):
                    left.append(rest)
            yield box.pieces


def pack(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); ``with_ids`` adds the packed ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        rows: list[tuple] = []

        def place(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                raw = p.ids.tobytes()
                row = (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, sequence, offset)
                rows.append((*row, raw) if with_ids else row)
                offset += len(p.ids)
            sequence += 1

        for batch, packed in tokenized(batches, path, end_id):
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), packed, strict=True):
                for pieces in packer.add(doc_id, np.frombuffer(raw, "<u4")):
                    place(pieces)
            if len(rows) >= _ROWS or with_ids and rows:
                yield _batch(rows, with_ids)
                rows = []
        for pieces in packer.finish():
            place(pieces)
        if rows:
            yield _batch(rows, with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op4_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces of what the stages before kept, each with its token ids."""
    return pack(docs, with_ids=True)
