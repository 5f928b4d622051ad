"""Fill-in-the-middle by secondary sort.

A text is cut into lines and two of the places between them, drawn from a hash of
its id, part it into prefix, middle and suffix. The parts leave as pieces of whole
lines (a longer line is cut), keyed by row and place in the output. Repartitioning
by row and sorting within partitions brings the pieces of a document together in
the order of the output, so a task streams them: into a digest, or into the
assembled text, however long a document is. The streamed output is read back into
its parts at the sentinels, each piece gets its place in the text, and a second
sort within the same partitions (no exchange) restores the text piece by piece.

Defined results: a NULL text is empty; an empty one, one that holds a sentinel,
and one that the rate passes over stay plain, with NULL parts; a NULL id is hashed
as no digits; equal rows are transformed one by one, each under a number of its
own; a line longer than a piece is cut at any byte, which the digests don't see.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import table, utf8

#: The sentinels, and the orders in which the parts follow them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Where a part stands in the text.
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_SENTINEL = re.compile(rb"<[PSM]>")
_OPEN_END = re.compile(rb"<[PSM]?\Z")  # may go on as a sentinel in the next piece
#: Bytes of a piece, and of the pieces handed to Spark at once.
PIECE_BYTES = 16 << 10
BATCH_BYTES = 8 << 20
PIECES = "row long, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, body binary"
RESTORED = "row long, part int, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, body binary"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
TEXTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rates:
    """Percent of texts that are parted, and of those the percent with the suffix first."""

    parted: int = 100
    suffix_first: int = 50
    seed: int = 7


@dataclass
class _Rows:
    """Rows gathered by column until a batch is full."""

    schema: str
    names: list[str] = field(init=False)
    types: list[pa.DataType] = field(init=False)
    rows: list[tuple] = field(init=False, default_factory=list)
    size: int = field(init=False, default=0)

    def __post_init__(self):
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        columns = [c.split() for c in self.schema.split(", ")]
        self.names, self.types = [c[0] for c in columns], [kinds[c[1]] for c in columns]

    def add(self, row: tuple, weight: int) -> None:
        self.rows.append(row)
        self.size += weight + 64

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.names)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], self.names)
        self.rows, self.size = [], 0
        return out


def _chunks(text: memoryview, ends: np.ndarray, size: int) -> Iterator[memoryview]:
    """Runs of whole units up to ``size`` bytes; a longer unit is cut."""
    start, total = 0, len(text)
    while total - start > size:
        k = int(np.searchsorted(ends, start + size, "right"))
        stop = int(ends[k - 1]) if k and ends[k - 1] > start else start + size
        yield text[start:stop]
        start = stop
    yield text[start:]


def _code_points(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def cut_text(doc_id: int | None, text: bytes, rates: Rates = Rates(), size: int = PIECE_BYTES) -> tuple[tuple, list[bytes]]:
    """``(n, form, prefix_chars, middle_chars)`` and the output's pieces in order."""
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    n = len(ends)
    digest = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    view = memoryview(text)
    if not text or _SENTINEL.search(text) or h3 % 100 >= rates.parted:
        return (n, "plain", None, None), [bytes(c) for c in _chunks(view, ends, size)]
    form = "spm" if h4 % 100 < rates.suffix_first else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(ends[x - 1]) if x else 0 for x in (a, b))
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
    pieces = []
    for mark in ORDERS[form]:
        start, stop = spans[mark]
        for i, chunk in enumerate(_chunks(view[start:stop], ends - start, size)):
            pieces.append((mark if i == 0 else b"") + bytes(chunk))
    return (n, form, _code_points(data[:first]), _code_points(data[first:second])), pieces


def output_pieces(docs: DataFrame, rates: Rates = Rates(), size: int = PIECE_BYTES) -> DataFrame:
    """Pieces of every output, those of a row in one partition and in order.

    The first piece of a row carries what is known of the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(PIECES)
        for batch in batches:
            for row, doc_id, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                known, pieces = cut_text(doc_id, text, rates, size)
                for place, body in enumerate(pieces):
                    out.add((row, place, doc_id, *(known if place == 0 else (None,) * 4), body), len(body))
                    if out.size >= BATCH_BYTES:
                        yield out.batch()
        yield out.batch()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    # With the sort this is repartitionAndSortWithinPartitions in columns.
    return rows.mapInArrow(run, PIECES).repartition("row").sortWithinPartitions("row", "place")


def _documents(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows in order, with whether each opens a new document."""
    last = None
    for batch in batches:
        for values in zip(*(batch[c].to_pylist() for c in ("row", *columns)), strict=True):
            yield values[0] != last, values
            last = values[0]


def assemble(pieces: DataFrame) -> DataFrame:
    """Output texts from ``output_pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, held = _Rows(TEXTS), None, []
        for opens, (_, doc_id, n, form, prefix, middle, body) in _documents(batches, ("doc_id", "n", "form", "prefix_chars", "middle_chars", "body")):
            if opens:
                if head:
                    out.add((*head, (whole := b"".join(held)).decode()), len(whole))
                    if out.size >= BATCH_BYTES:
                        yield out.batch()
                head, held = (doc_id, n, form, prefix, middle), []
            held.append(body)
        if head:
            out.add((*head, b"".join(held).decode()), 0)
        yield out.batch()

    return pieces.mapInArrow(run, TEXTS)


class _Reader:
    """Reads an output piece by piece back into parts of the text."""

    def __init__(self, form: str):
        self.plain, self.rank, self.open, self.place = form == "plain", 0, b"", 0

    def parts(self, body: bytes, last: bool = False) -> Iterator[tuple[int, int, bytes]]:
        """``(part, place, bytes)`` of what ``body`` adds."""
        if self.plain:
            yield self._next(body)
            return
        body, at = self.open + body, 0
        for mark in _SENTINEL.finditer(body):
            if mark.start() > at:
                yield self._next(body[at:mark.start()])
            self.rank, at = RANK[mark.group()], mark.end()
        tail = None if last else _OPEN_END.search(body, at)
        stop = tail.start() if tail else len(body)
        self.open = body[stop:]
        if stop > at:
            yield self._next(body[at:stop])

    def _next(self, body: bytes) -> tuple[int, int, bytes]:
        self.place += 1
        return self.rank, self.place, body


def restoring_pieces(pieces: DataFrame) -> DataFrame:
    """Digests of the outputs, and the pieces read back from them in the text's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head = _Rows(RESTORED), None

        def close() -> None:
            for part, place, some in reader.parts(b"", last=True):
                out.add((head[0], part, place, *(None,) * 6, some), len(some))
            # Part -1 stands before every other.
            out.add((head[0], -1, 0, *head[1:], digest.hexdigest(), None), 0)

        for opens, (row, doc_id, n, form, prefix, middle, body) in _documents(batches, ("doc_id", "n", "form", "prefix_chars", "middle_chars", "body")):
            if opens:
                if head:
                    close()
                head, digest, reader = (row, doc_id, n, form, prefix, middle), hashlib.sha256(), _Reader(form)
            digest.update(body)
            for part, place, some in reader.parts(body):
                out.add((row, part, place, *(None,) * 6, some), len(some))
            if out.size >= BATCH_BYTES:
                yield out.batch()
        if head:
            close()
        yield out.batch()

    # Rows of a document are in one partition already: the sort alone restores them.
    return pieces.mapInArrow(run, RESTORED).sortWithinPartitions("row", "part", "place")


def restored_digests(restoring: DataFrame) -> DataFrame:
    """``RESULT`` from ``restoring_pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head = _Rows(RESULT), None
        names = ("part", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "body")
        for opens, (_, part, doc_id, n, form, prefix, middle, sha, body) in _documents(batches, names):
            if opens:
                if head:
                    out.add((*head, digest.hexdigest()), 128)
                    if out.size >= BATCH_BYTES:
                        yield out.batch()
                head, digest = (doc_id, n, form, prefix, middle, sha), hashlib.sha256()
            if part >= 0:
                digest.update(body)
        if head:
            out.add((*head, digest.hexdigest()), 0)
        yield out.batch()

    return restoring.mapInArrow(run, RESULT)


def fill_in_middle(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Every document's transformed text."""
    return assemble(output_pieces(docs, rates))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's transformed text and of the text restored from it."""
    return restored_digests(restoring_pieces(output_pieces(table(spark, sf_dir, "documents"))))


#: DuckDB SQL for op13_fill_in_middle.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS units,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
v AS (SELECT *, len(units) AS n FROM u),
w AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM v),
x AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM w)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256 FROM x
"""
