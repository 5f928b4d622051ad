"""Token-id shards under Re-Pair grammar compression.

Documents are ordered by ``doc_id`` over range partitions; each partition writes
shards of about ``SHARD_TOKENS`` ids. In a shard, frequent pairs of neighbouring
symbols are replaced by nonterminals again and again, a batch of pairs a round.
A rule keeps its two symbols and the length of its expansion, so that any token
range of a document is found and expanded without the rest. No rule reaches over
a document's end.

A shard is one row of a Parquet table, its image a binary column: Spark's own
committer then leaves no half-written shard behind when an executor is lost.

Image, little-endian: magic ``RPG1``; u32 documents, u32 rules, u64 symbols, u32
terminals, u32 end id; doc ids i64, NULL flags u8, symbol starts u64 (one more
than documents), token counts u64; rules as left u16, right u16, expansion u32;
symbols u16 (u32 if any symbol needs it).

Defined results: NULL and empty texts are the end id alone; rows with equal ids
stand in order of their text, NULL ids first; an empty table gives no shards.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import table
from labelscope.llm.subwords import tokenized
from labelscope.session import shared_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TERMINALS = 50_257
END_ID = 0
#: Ids of a shard; the last document of a shard may go over it.
SHARD_TOKENS = 4 << 20
#: Words whose ids a worker keeps.
KNOWN_WORDS = 1_200_000
ROUNDS = 3
PAIRS_PER_ROUND = 5093
#: A pair this rare is no rule.
LEAST_USES = 6
_HEADER = struct.Struct("<4sIIQII")
SHARDS = "task long, number long, n_docs long, n_tokens long, image binary"
DOCUMENTS = "task long, number long, place long, doc_id long, n_tokens long, ids_crc32 long, before long"


def _frequent(keys: np.ndarray, most: int, end_id: int) -> np.ndarray:
    """Pairs met ``LEAST_USES`` times or more that ``end_id`` does not open, most frequent first, ``most`` at most."""
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    hit = np.flatnonzero(counts >= LEAST_USES)
    hit = hit[ordered[starts[hit]] >> np.uint32(16) != end_id]
    if len(hit) > most:
        hit = hit[np.argpartition(-counts[hit], most)[:most]]
    hit = hit[np.lexsort((ordered[starts[hit]], -counts[hit]))]
    return ordered[starts[hit]]


def build_grammar(ids: np.ndarray, terminals: int = TERMINALS, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, rules)``: rules are rows of left, right, expansion length."""
    symbols = ids.astype(np.uint32)
    rules = np.zeros((0, 3), np.uint32)
    limit = 1 << 16
    if terminals >= limit:
        return symbols, rules
    for turn in range(ROUNDS):
        room = min(PAIRS_PER_ROUND, limit - terminals - len(rules))
        if room <= 0 or len(symbols) < 2:
            break
        keys = symbols[:-1] << np.uint32(16) | symbols[1:]
        chosen = _frequent(keys, room, end_id)
        if not len(chosen):
            break
        # A table by multiplicative hash gives each place its pair's rank; of pairs
        # that share a slot the most frequent stays, the others wait for a next round.
        factor = np.uint32(2654435761 + 2 * turn * 40503)
        slot = lambda k: (k * factor) >> np.uint32(14)
        ranks = np.full(1 << 18, -1, np.int16)
        ranks[slot(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int16)[::-1]
        rank = ranks[slot(keys)]
        place = np.flatnonzero(rank >= 0)
        rank = rank[place]
        place, rank = (x[chosen[rank] == keys[place]] for x in (place, rank))
        # Overlapping pairs: the more frequent one wins, the left one of equals.
        touch = place[1:] == place[:-1] + 1
        wins = np.ones(len(place), bool)
        wins[1:] &= ~touch | (rank[1:] < rank[:-1])
        wins[:-1] &= ~touch | (rank[:-1] <= rank[1:])
        taken, rank = place[wins], rank[wins]
        uses = np.bincount(rank, minlength=len(chosen))
        kept = uses >= LEAST_USES
        if not kept.any():
            break
        taken, rank = taken[kept[rank]], rank[kept[rank]]
        fresh = np.cumsum(kept, dtype=np.uint32) - np.uint32(1) + np.uint32(terminals + len(rules))
        pairs = chosen[kept]
        left, right = pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)
        span = lambda s, rules=rules: np.where(s < terminals, 1, rules[np.where(s < terminals, 0, s - terminals), 2]) if len(rules) else np.ones(len(s))
        symbols[taken] = fresh[rank]
        alive = np.ones(len(symbols), bool)
        alive[taken + 1] = False
        symbols = symbols[alive]
        rules = np.concatenate([rules, np.stack([left, right, (span(left) + span(right)).astype(np.uint32)], axis=1).astype(np.uint32)])
        if len(taken) < 0.01 * len(symbols):
            break
    return symbols, rules


def write_image(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, terminals: int = TERMINALS, end_id: int = END_ID) -> bytes:
    """The image of a shard from its documents' ids, each document closed by ``end_id``."""
    symbols, rules = build_grammar(ids, terminals, end_id)
    spans = np.ones(terminals + len(rules), np.int64)
    spans[terminals:] = rules[:, 2]
    reached = np.concatenate([[0], np.cumsum(spans[symbols])])
    starts = np.searchsorted(reached, np.concatenate([[0], np.cumsum(lengths)]))
    wide = len(symbols) and int(symbols.max()) >= 1 << 16
    return b"".join([
        _HEADER.pack(b"RPG1", len(doc_ids), len(rules), len(symbols), terminals, end_id),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts.astype("<u8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
        rules[:, 0].astype("<u2").tobytes(), rules[:, 1].astype("<u2").tobytes(), rules[:, 2].astype("<u4").tobytes(),
        symbols.astype("<u4" if wide else "<u2").tobytes(),
    ])


class Shard:
    """Reads an image; ``tokens`` expands only what is asked for."""

    def __init__(self, image: bytes):
        magic, docs, rules, symbols, self.terminals, self.end_id = _HEADER.unpack_from(image)
        if magic != b"RPG1":
            raise ValueError("not a shard image")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        ids, absent = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if a else int(i) for i, a in zip(ids, absent, strict=True)]
        self.starts, self.lengths = take("<u8", docs + 1).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.left, self.right, spans = take("<u2", rules), take("<u2", rules), take("<u4", rules)
        self.symbols = take("<u2" if (len(image) - at) == 2 * symbols else "<u4", symbols)
        self.spans = np.concatenate([np.ones(self.terminals, np.int64), spans])
        # All expansions in one array; a rule's two symbols come before it.
        self.place = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(spans, dtype=np.int64) - spans])
        self.flat = np.zeros(self.terminals + int(spans.sum()), "<u4")
        self.flat[:self.terminals] = np.arange(self.terminals)
        # Rules in turns: those whose symbols are both there, all at once.
        known = np.arange(len(self.spans)) < self.terminals
        open_rules = np.arange(rules)
        while len(open_rules):
            ready = known[self.left[open_rules]] & known[self.right[open_rules]]
            now, open_rules = open_rules[ready], open_rules[~ready]
            if not len(now):
                raise ValueError("a rule uses a later one")
            pairs = np.stack([self.left[now], self.right[now]], axis=1).ravel()
            self.flat[self._places(now + self.terminals)] = self.expand(pairs)
            known[now + self.terminals] = True

    def _places(self, symbols: np.ndarray) -> np.ndarray:
        """Where the expansions of ``symbols`` stand in ``flat``, one after another."""
        spans = self.spans[symbols]
        ends = np.cumsum(spans)
        return np.repeat(self.place[symbols] - ends + spans, spans) + np.arange(int(ends[-1]) if len(ends) else 0)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[self._places(symbols)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[i]:self.starts[i + 1]])

    def tokens(self, i: int, first: int, last: int) -> np.ndarray:
        """Tokens ``first`` to ``last`` (exclusive) of document ``i``."""
        own = self.symbols[self.starts[i]:self.starts[i + 1]]
        ends = np.cumsum(self.spans[own])
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
        skip = first - (int(ends[a - 1]) if a else 0)
        return self.expand(own[a:b])[skip:skip + last - first]


def write_shards(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID,
                 terminals: int = TERMINALS, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the shards of ``docs`` (doc_id, text) to ``folder``, in order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            image = write_image(names, lengths, np.frombuffer(b"".join(ids), "<u4"), terminals, end_id)
            return pa.RecordBatch.from_pylist(
                [{"task": task, "number": number, "n_docs": len(names), "n_tokens": int(lengths.sum()), "image": image}])

        for batch, packed in tokenized(batches, path, end_id, KNOWN_WORDS):
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), packed, strict=True):
                ids.append(raw)
                names.append(doc_id)
                held += len(raw) // 4
                if held >= shard_tokens:
                    yield shard()
                    ids, names, held, number = [], [], 0, number + 1
        if ids:
            yield shard()

    # Range partitions keep the order of their numbers; equal ids spread by their texts' lengths.
    ordered = docs.select("doc_id", "text", F.octet_length("text").alias("_n")).repartitionByRange("doc_id", "_n").sortWithinPartitions("doc_id", "_n", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(folder)


def read_shards(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards of ``folder``."""
    shards = spark.read.schema(SHARDS).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["image"])
                whole, ends = memoryview(shard.expand(shard.symbols)).cast("B"), (4 * np.cumsum(shard.lengths)).tolist()
                crcs = [zlib.crc32(whole[a:b]) for a, b in zip([0, *ends], ends)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["task"]] * n, pa.int64()), pa.array([row["number"]] * n, pa.int64()), pa.array(range(n), pa.int64()),
                    pa.array(shard.doc_ids, pa.int64()), pa.array(shard.lengths), pa.array(crcs, pa.int64()),
                    pa.array(np.cumsum(shard.lengths) - shard.lengths),
                ], [c.split()[0] for c in DOCUMENTS.split(", ")])

    # A running sum over one row a shard.
    order = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("task", "number", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("first"))
    read = shards.select("task", "number", "image").mapInArrow(run, DOCUMENTS)
    return read.join(starts, ["task", "number"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_repair_shards(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written as grammar shards and read back."""
    folder = shared_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder)
