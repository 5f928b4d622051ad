"""Cross-tokenizer alignment over inverted pair bitmaps.

Two tokenizers cut the same bytes, a blank and the text. Where tokens of both end,
a group ends, and the two tokens that end there are linked. How often an id pair
is linked in the whole corpus says which links are the usual ones.

Tasks number their documents within blocks. A block keeps an inverted index: for
each id pair a compressed bitmap of the documents that link it (a sorted list of
16-bit numbers, or 65,536 bits where that is smaller), and bit planes of how often
beyond once. Batches of documents are OR-merged into their block's bitmaps, planes
added; popcounts give a block's documents and links of a pair, which Spark sums
over blocks. Postings then return: each, with its pair's count, goes to its block
and gives the count to its documents as often as the planes say.

No row holds more than one pair of one block, and a pair has at most one row a
block, so no pair, however common, is larger than the number of blocks.

Text is cut into units where neither tokenizer reaches across (before blanks, and
between letters and other characters); a bounded table keeps the tokens of units.

Defined results: texts that are NULL, empty, or not given back by the second
tokenizer's pieces (they hold its own blank mark) have no tokens; strings of
special tokens are plain text; equal rows and NULL ids are documents of their own;
a very long text is read in runs of units.
"""

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelscope.llm.common import kept, table
from labelscope.llm.pieces import _LETTER, BLANK, Encoder, PieceModel
from labelscope.session import shared_folder

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Fixed value: how byte-level vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond which a unit goes to the file's own library.
LONG_UNIT = 1000
#: Units whose tokens a worker keeps, and units of a text that are looked at together.
KNOWN_UNITS = 400_000
RUN_UNITS = 200_000
#: A block ends at this many documents (the numbers of a bitmap), or about this many links.
BLOCK_DOCS = 1 << 16
BLOCK_LINKS = 1 << 20
#: From this many documents on a bitmap is smaller than a list.
LIST_DOCS = 4096

_REGULAR = re.compile(rf"[{_LETTER}\n -~]*\Z")
#: White space by which the first tokenizer splits, beyond the blank and the line end.
_OTHER_BLANKS = re.compile("[\t\x0b-\r\x85\xa0  -     　]")
# Letters after an apostrophe stay with it: it may begin a contraction.
_FINE = re.compile(rf"[ \n]*(?:[{_LETTER}]+|[^ \n{_LETTER}]*'[{_LETTER}]+|[^ \n{_LETTER}]+)|[ \n]+")
_COARSE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

ROWS = ("block long, slot int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
        "a int, b int, n_docs long, n_links long, planes binary")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def units_of(text: str) -> Iterator[str]:
    """Parts of a blank and ``text`` that both tokenizers encode on their own."""
    whole = " " + text
    if _OTHER_BLANKS.search(whole):
        yield whole
        return
    found = (_FINE if _REGULAR.match(whole) else _COARSE).finditer(whole)
    yield from (m.group() for m in found)


class ByteLevel:
    """Ids of units under a byte-level vocabulary, strings of special tokens as plain text.

    Where ids stand in the order of merges, ranks say the same as the list of merges,
    and ``tiktoken`` merges by them faster than the library of the file does. Longer
    units go to the library, whose work grows slower with their length.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        model = json.loads(self.library.to_str())["model"]
        vocabulary, merges = model["vocab"], model["merges"]
        letters = bytes_of_letters()
        raw = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items()}
        self.sizes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for piece, i in raw.items():
            self.sizes[i] = len(piece)
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ranked = [vocabulary.get(j) for j in joined] == list(range(256, 256 + len(merges)))
        self.ranks = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=raw, special_tokens={}) if ranked else None

    def encode(self, units: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]
        ordinary = self.ranks.encode_ordinary
        return [ordinary(u) if len(u) <= LONG_UNIT else self.library.encode(u, add_special_tokens=False).ids for u in units]


def bytes_of_letters() -> dict[str, int]:
    """Bytes by the letters that byte-level vocabularies write them with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Tokens, groups and links of units, computed once while they stay in the table."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, limit: int = KNOWN_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.first = ByteLevel(byte_level)
        self.second = Encoder(PieceModel.load(pieces))
        lib = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.library = lib
        self.blank = lib.piece_to_id(BLANK)
        self.second_bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(BLANK, " ").encode()
                             for i, p in enumerate(map(lib.id_to_piece, range(lib.get_piece_size())))]
        self.second_sizes = np.array([len(b) for b in self.second_bytes])
        self.limit = limit
        self._renew()

    def _renew(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = [np.zeros((0, 4), np.int64)]  # n_a, n_b, n_groups, whether the unit can be spelled
        self.links = [np.zeros(0, np.int64)]
        self.flat: tuple | None = None

    def places(self, units: list[str]) -> np.ndarray:
        """Numbers of ``units`` in the table, for ``tables`` until the next call."""
        new = {u for u in units if u not in self.index}
        if new:
            if len(self.index) + len(new) > self.limit:
                self._renew()
                new = set(units)
            self._learn(list(new))
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts by unit, where its links start, and all links."""
        if self.flat is None:
            self.counts, self.links = [np.concatenate(self.counts)], [np.concatenate(self.links)]
            self.flat = self.counts[0], np.cumsum(self.counts[0][:, 2]) - self.counts[0][:, 2], self.links[0]
        return self.flat

    def _learn(self, new: list[str]) -> None:
        first, second, raw = self.first.encode(new), self._second(new), [u.encode() for u in new]
        spelled = b"".join([self.second_bytes[i] for ids in second for i in ids])
        good = np.array([self._sizes(ids) == len(r) for ids, r in zip(second, raw, strict=True)])
        if not good.all() or spelled != b"".join(raw):
            good = np.array([b"".join([self.second_bytes[i] for i in ids]) == r for ids, r in zip(second, raw, strict=True)])
            first, second = ([ids if g else [] for ids, g in zip(side, good, strict=True)] for side in (first, second))
        n_a, n_b = (np.array([len(x) for x in side]) for side in (first, second))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((first, n_a), (second, n_b)))
        # Both run over the same bytes, so ends of all units at once meet where they meet in each.
        _, at_a, at_b = np.intersect1d(np.cumsum(self.first.sizes[a]), np.cumsum(self.second_sizes[b]), assume_unique=True, return_indices=True)
        owner = np.repeat(np.arange(len(new)), n_a)[at_a]
        n_groups = np.bincount(owner, minlength=len(new))
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        stops_a, stops_b = (at_a + 1).tolist(), (at_b + 1).tolist()
        spelled = [f"{','.join(names_a[p:q])}|{','.join(names_b[r:s])}"
                   for p, q, r, s in zip([0, *stops_a], stops_a, [0, *stops_b], stops_b)]
        ends = np.cumsum(n_groups).tolist()
        self.groups += [";".join(spelled[p:q]).encode() for p, q in zip([0, *ends], ends)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.counts.append(np.stack([n_a, n_b, n_groups, good], axis=1).astype(np.int64))
        self.links.append(pair_key(a[at_a], b[at_b]))
        self.flat = None

    def _sizes(self, ids: list[int]) -> int:
        return sum([len(self.second_bytes[i]) for i in ids])

    def _second(self, new: list[str]) -> list[list[int]]:
        """The library puts a blank before a text: here it is the unit's own, or goes
        again before a line end, which no piece holds."""
        out: list[list[int]] = [[]] * len(new)
        blank = [i for i, u in enumerate(new) if u[0] == " "]
        line = [i for i, u in enumerate(new) if u[0] == "\n"]
        for some, skip, drop in ((blank, 1, 0), (line, 0, 1)):
            for i, ids in zip(some, self.library.encode([new[i][skip:] for i in some], num_threads=1), strict=True):
                # A lone blank is an empty text to the library.
                out[i] = ids[drop:] if ids else [self.blank]
        for i in set(range(len(new))).difference(blank, line):
            out[i] = [x for part in self.second.parts(new[i]) for x in self.second._part(part)] if BLANK not in new[i] else []
        return out

    def runs(self, texts: list[str | None]) -> Iterator[tuple[int, bool, list[str]]]:
        """``(text, whether it ends here, units)``, long texts in several runs."""
        for i, text in enumerate(texts):
            found = units_of(text) if text else iter(())
            held = list(islice(found, RUN_UNITS))
            while len(held) == RUN_UNITS:
                yield i, False, held
                held = list(islice(found, RUN_UNITS))
            yield i, True, held

    def align(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray]]:
        """Batches of finished documents ``(n_a, n_b, n_groups, digest)``, and their links
        as documents (counted from the batch's first) and pair keys."""
        held: list[tuple[int, bool, list[str]]] = []
        size = 0
        carry = None
        for run in self.runs(texts):
            held.append(run)
            size += len(run[2])
            if size >= RUN_UNITS:
                *out, carry = self._batch(held, carry)
                yield tuple(out)
                held, size = [], 0
        *out, carry = self._batch(held, carry)
        yield tuple(out)

    def _batch(self, held, carry):
        """A text that goes on after the batch is carried: counts, digest, and links so far."""
        at = self.places([u for *_, units in held for u in units])
        counts, starts, links = self.tables()
        done, docs, pairs, first = [], [], [], 0
        for _, ends, units in held:
            own = at[first:first + len(units)]
            first += len(units)
            total = counts[own].sum(axis=0) if len(own) else np.zeros(4, np.int64)
            total[3] = len(own) - total[3]  # units that cannot be spelled
            spelled = b";".join([g for i in own.tolist() if (g := self.groups[i])])
            sizes = counts[own, 2]
            found = links[np.repeat(starts[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
            if carry is None:
                sums, digest, before = total, hashlib.sha256(spelled), []
            else:
                sums, digest, before = carry[0] + total, carry[1], carry[2]
                digest.update((b";" if carry[0][2] and spelled else b"") + spelled)
            if not ends:
                carry = sums, digest, [_counted(np.concatenate([*(np.repeat(*x) for x in before), found]))]
                continue
            carry = None
            if sums[3] or not sums[2]:
                done.append((0, 0, 0, ""))
                continue
            for keys, times in before:
                found = np.concatenate([found, np.repeat(keys, times)])
            docs.append(np.full(len(found), len(done), np.int64))
            pairs.append(found)
            done.append((*sums[:3].tolist(), digest.hexdigest()))
        none = [np.zeros(0, np.int64)]
        return done, np.concatenate(docs or none), np.concatenate(pairs or none), carry


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 24 | b


# ---- postings ----

def pack(slots: np.ndarray) -> bytes:
    """A set of 16-bit numbers: their count, then a sorted list or a bitmap."""
    if len(slots) < LIST_DOCS:
        return struct.pack("<I", len(slots)) + slots.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_DOCS, np.uint8)
    bits[slots] = 1
    return struct.pack("<I", len(slots)) + np.packbits(bits, bitorder="little").tobytes()


def unpack(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The set at ``at``, and where the next one starts."""
    n = struct.unpack_from("<I", raw, at)[0]
    if n < LIST_DOCS:
        return np.frombuffer(raw, "<u2", n, at + 4).astype(np.int64), at + 4 + 2 * n
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, BLOCK_DOCS // 8, at + 4), bitorder="little")
    return np.flatnonzero(bits), at + 4 + BLOCK_DOCS // 8


def pack_planes(slots: np.ndarray, times: np.ndarray) -> bytes:
    """The documents of a pair, then bit planes of how often beyond once they link it."""
    out, beyond = [pack(slots)], times - 1
    while beyond.any():
        out.append(pack(slots[beyond & 1 == 1]))
        beyond = beyond >> 1
    return b"".join(out)


def unpack_planes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    slots, at = unpack(raw)
    times = np.ones(len(slots), np.int64)
    plane = 0
    while at < len(raw):
        some, at = unpack(raw, at)
        times[np.searchsorted(slots, some)] += 1 << plane
        plane += 1
    return slots, times


def popcounts(raw: bytes) -> tuple[int, int]:
    """Documents and links of a pair in a block: counts of the sets, planes weighed by their place."""
    at, sizes = 0, []
    while at < len(raw):
        n = struct.unpack_from("<I", raw, at)[0]
        sizes.append(n)
        at += 4 + (2 * n if n < LIST_DOCS else BLOCK_DOCS // 8)
    return sizes[0], sizes[0] + sum(n << i for i, n in enumerate(sizes[1:]))


class Block:
    """An inverted index of a run of documents, batches merged into it."""

    def __init__(self, number: int):
        self.number = number
        self.docs: list[tuple] = []
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.links = 0

    def add(self, ids: list[int | None], done: list[tuple], docs: np.ndarray, pairs: np.ndarray) -> None:
        first = len(self.docs)
        self.docs += [(i, *d) for i, d in zip(ids, done, strict=True)]
        keys, times = _counted(pairs << 16 | docs + first) if len(pairs) else (pairs, pairs)
        self.waiting.append((keys, times))
        self.links += len(keys)

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.links >= BLOCK_LINKS

    def merge(self) -> None:
        """The union of what batches found; a document is in one batch, so planes need no carry."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        times = np.concatenate([self.times, *(t for _, t in self.waiting)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.times, self.waiting = keys[order], times[order], []

    def batches(self) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        ids, n_a, n_b, n_groups, digests = zip(*self.docs, strict=True)
        yield _rows(block=[self.number] * n, slot=range(n), doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups, groups_sha256=digests)
        self.merge()
        pairs, starts = np.unique(self.keys >> 16, return_index=True)
        slots, ends = self.keys & 0xFFFF, [*starts.tolist(), len(self.keys)]
        for at in range(0, len(pairs), 50_000):
            some = pairs[at:at + 50_000]
            planes = [pack_planes(slots[p:q], self.times[p:q]) for p, q in zip(ends[at:at + len(some)], ends[at + 1:at + len(some) + 1], strict=True)]
            counts = [popcounts(p) for p in planes]
            yield _rows(block=[self.number] * len(some), a=some >> 24, b=some & 0xFFFFFF,
                        n_docs=[c[0] for c in counts], n_links=[c[1] for c in counts], planes=planes)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    names, kinds = zip(*((c.split()[0], _KINDS[c.split()[1]]) for c in ROWS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], list(names))


def write_index(docs: DataFrame, folder: str, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> None:
    """Documents (with ``slot``) and postings (with ``a``, ``b``) of every block, to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", byte_level, pieces), lambda: Aligner(byte_level, pieces))
        task, blocks = TaskContext.get().partitionId(), 0
        block = Block(task << 32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids, first = some["doc_id"].to_pylist(), 0
                for done, found, pairs in aligner.align(some["text"].to_pylist()):
                    block.add(ids[first:first + len(done)], done, found, pairs)
                    first += len(done)
                    if block.full() or len(block.docs) + 500 > BLOCK_DOCS:
                        yield from block.batches()
                        blocks += 1
                        block = Block(task << 32 | blocks)
        if block.docs:
            yield from block.batches()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS).write.parquet(folder)


def pair_counts(index: DataFrame) -> DataFrame:
    """``a, b, pair_docs, pair_links, best``: popcounts over all blocks, and whether no id is linked with b more often."""
    counts = index.where("a is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("pair_docs"), F.sum("n_links").alias("pair_links"))
    highest = counts.groupBy("b").agg(F.max("pair_links").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "pair_docs", "pair_links", (F.col("pair_links") == F.col("highest")).alias("best"))


def document_scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """``RESULT``: every posting gives its pair's count to its block's documents."""

    def run(docs: pa.Table, postings: pa.Table) -> pa.Table:
        n = docs.num_rows
        places = docs["slot"].to_numpy()
        size = int(places.max()) + 1 if n else 0
        links, best, sums = (np.zeros(size, np.int64) for _ in range(3))
        for raw, count, usual in zip(*(postings[c].to_pylist() for c in ("planes", "pair_links", "best")), strict=True):
            slots, times = unpack_planes(raw)
            links[slots] += times
            sums[slots] += count * times
            if usual:
                best[slots] += times
        return pa.table({
            **{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups")},
            "n_links": links[places], "n_best": best[places], "count_sum": sums[places], "groups_sha256": docs["groups_sha256"]})

    docs = index.where("slot is not null").select(F.col("block").alias("of"), "slot", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    postings = index.where("a is not null").select("block", "a", "b", "planes").join(counts, ["a", "b"]).select("block", "planes", "pair_links", "best")
    return docs.groupBy("of").cogroup(postings.groupBy("block")).applyInArrow(run, RESULT)


def align_documents(docs: DataFrame) -> DataFrame:
    """Groups, links and corpus-wide counts of every document's tokens."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "pairs")
    write_index(docs, folder)
    index = spark.read.schema(ROWS).parquet(folder)
    return document_scores(index, pair_counts(index))


def op12_pair_alignment(spark, sf_dir: str) -> DataFrame:
    """Two public tokenizers aligned over all documents."""
    return align_documents(table(spark, sf_dir, "documents"))
