"""Language-model scores of whole texts by context-tree weighting.

A text is its lower-cased words, each closed by a blank, and an end. The model is a
context tree over these bytes (``ctw``), learned from all training texts: contexts are
the bytes before, across words and back to the start of the text, or (``across`` unset)
back to the start of the word. Beside it stands an add-one word model.

Nothing is learned on the driver and no table is broadcast; all grow with the corpus:

1. Tasks cut documents into blocks. A block numbers its distinct words; documents are
   lists of these numbers. Words are dealt by hash, counted over blocks, and their counts
   return in the order in which the block dealt them.
2. A block's distinct grams are taken lot by lot, dealt by their nearest five context bytes,
   summed over blocks, and dealt again by the nearest three, below which each subtree is worked out
   where it lies, some contexts at a time.
3. Nodes of up to two bytes are summed level by level in Spark, and the mixture above
   is joined down to the subtrees.
4. Gram probabilities return to the blocks the way the grams came, and are added up along the texts.

Words and gram tables travel as packed arrays, a row for a block and a share of the hash space;
their scores travel in single precision (a relative error of 3e-8 at most) and are added in double.
Hot words have one entry a block, and a hot context at most its distinct grams a block;
the subtree of one context holds its distinct grams only.

Defined results: NULL and empty texts are the end alone; without training texts every
bit has one half, and the base score is that of the add-one formula; rows without id
are learned from; equal rows count as often as they occur; a long text spans blocks.
"""

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm import ctw
from labelscope.llm.common import fold_of, table, utf8
from labelscope.session import shared_folder

FOLDS, HELD_OUT = 7, 2
#: Tokens of a block, bytes of a task's first block, bytes of a text that are split at once, words of a lot.
BLOCK_TOKENS = 3 << 20
BLOCK_BYTES = 18 << 20
CHUNK = 4 << 20
LOT_WORDS = 1 << 17
#: Half the bytes of texts for which there is one share of the hash space.
SHARE_BYTES = 4 << 20
#: Context bytes that decide the share of a gram, and grams that are merged at once into those of a share.
NEAR = 5
MERGED = 1 << 22
#: An odd factor, which spreads grams over 64 bits and keeps them apart.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCKS = ("block long, docs binary, doc_ids binary, absent binary, held binary, "
          "tokens binary, sizes binary, slots binary, words binary, pasts binary, share int, listed binary, times binary, keys binary, seen binary")


def squeeze(values: np.ndarray, level: int = 1) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), level)


def release(raw: bytes, kind: str) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """How many keys; of each, how many of its first bytes are those of the key before; the others, by place."""
    raw, new, shared, parts = keys.astype(">u8").view(np.uint8).reshape(-1, 8), np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8), []
    for j in range(8):
        place = np.ascontiguousarray(raw[:, j])
        new |= np.diff(place, prepend=np.uint8(0)) != 0
        shared += ~new
        parts.append(place[new])
    return len(keys).to_bytes(8, "little") + zstandard.compress(np.concatenate([shared, *parts]).tobytes(), 1)


def release_sorted(raw: bytes) -> np.ndarray:
    data, n = np.frombuffer(zstandard.decompress(raw[8:]), np.uint8), int.from_bytes(raw[:8], "little")
    shared, at, out = data[:n], n, np.zeros((8, n), np.uint8)
    for j in range(8):
        told = np.cumsum(shared <= j, dtype=np.uint32)
        if n and told[-1]:
            part, at = data[at:at + told[-1]], at + int(told[-1])
            out[j] = np.concatenate([np.zeros(1, np.uint8), part])[told]
    return np.ascontiguousarray(out.T).reshape(-1).view(">u8").astype(np.uint64)


def gram_share(keys: np.ndarray, shares: int) -> np.ndarray:
    """A share for each gram, by its nearest ``NEAR`` context bytes: sorted grams of a share stay near each other and pack well."""
    return share_of(keys >> np.uint64(64 - 8 * NEAR), shares)


def share_of(keys: np.ndarray, shares: int) -> np.ndarray:
    """A share of the hash space for each key."""
    mixed = (keys ^ keys >> np.uint64(31)) * _SPREAD
    return ((mixed >> np.uint64(33)) % np.uint64(shares)).astype(np.int64)


def word_share(words: list[bytes], shares: int) -> np.ndarray:
    """A share of the hash space for each word."""
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shares


def dealt(share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each share, ascending."""
    # Small numbers are sorted by their digits.
    order = np.argsort(share.astype(np.uint16) if len(share) and share.max() < 1 << 16 else share, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], share[order][1:] != share[order][:-1]])) if len(order) else []
    for p, q in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(share[order[p]]), order[p:q]


# ---- blocks ----

def chunks(text: bytes) -> Iterator[bytes]:
    """Runs of whole words of a text."""
    start = 0
    while len(text) - start > CHUNK:
        blank = _BLANK.search(text, start + CHUNK)
        if not blank:
            break
        yield text[start:blank.start()]
        start = blank.end()
    yield text[start:]


class _Block:
    def __init__(self, number: int, across: bool, shares: int):
        self.number, self.across, self.shares, self.total = number, across, shares, 0
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.rows: list[tuple] = []  # document, doc_id, held, tokens, bytes
        self.slots: list[np.ndarray] = []
        self.pasts: list[bytes] = []
        self.stream: list[bytes] = []

    def add(self, doc: int, doc_id: int | None, held: bool, words: list[bytes], past: bytes) -> bytes:
        """Takes a run of words that stand after ``past``; what then stands before the next run."""
        self.slots.append(np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words)))
        self.pasts.append(past)
        closes = words[-1:] == [ctw.END]
        own = b"".join([ctw.START.join(words[:-1] if closes else words), ctw.START if len(words) > closes else b"", ctw.END if closes else b""])
        self.stream += (past, own)
        self.rows.append((doc, doc_id, held, len(words), len(own)))
        self.total += len(words)
        return b"".join([past, *(w + ctw.START for w in words[-ctw.DEPTH:])])[-ctw.DEPTH:]

    def batches(self) -> Iterator[pa.RecordBatch]:
        docs, ids, held, tokens, sizes = zip(*self.rows, strict=True)
        tokens, sizes = np.array(tokens, "<i8"), np.array(sizes, "<i8")
        slots, pasts, words = np.concatenate(self.slots), b"".join(self.pasts), list(self.index)
        learned = slots[np.repeat(~np.array(held, bool), tokens)]
        n = np.bincount(learned, minlength=len(self.index))
        yield _batch(BLOCKS, 1, block=[self.number], docs=[squeeze(np.array(docs, "<i8"))], doc_ids=[squeeze(np.array([i or 0 for i in ids], "<i8"))],
                     absent=[squeeze(np.array([i is None for i in ids], "u1"))], held=[squeeze(np.array(held, "u1"))],
                     tokens=[squeeze(tokens)], sizes=[squeeze(sizes)], slots=[squeeze(slots.astype("<u4"), 3)],
                     words=[zstandard.compress(ctw.START.join(words), 3)], pasts=[zstandard.compress(pasts, 1)])
        for share, at in dealt(word_share(words, self.shares)):
            listed = ctw.START.join([words[i] for i in at.tolist()])
            yield _batch(BLOCKS, 1, block=[self.number], share=[share], listed=[zstandard.compress(listed, 3)], times=[squeeze(n[at].astype("<i8"))])
        stream, self.index, self.slots, self.stream = b"".join(self.stream), {}, [], []
        del words, slots, learned, n
        keys, seen = self.grams(stream, np.array(held, bool), tokens, sizes)
        for share, at in dealt(gram_share(keys, self.shares)):
            yield _batch(BLOCKS, 1, block=[self.number], share=[share], keys=[squeeze_sorted(keys[at])], seen=[squeeze(seen[at].astype("<u8"))])

    def grams(self, stream: bytes, held: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of the block, and how often training texts hold each."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, part in lots(stream, tokens, sizes):
            keys = ctw.text_grams(part, sizes[rows], self.across)
            out = np.repeat(held[rows], sizes[rows])
            unseen, (learned, n) = ctw.distinct(keys[out])[0], ctw.distinct(keys[~out])
            found += [(learned, n.astype(np.uint32)), (unseen, np.zeros(len(unseen), np.uint32))]
            if len(found) > 8:
                found = [ctw.merged(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        return ctw.merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def stream_of(words: list[bytes], slots: np.ndarray, tokens: np.ndarray, pasts: bytes) -> bytes:
    """The bytes of a block's rows, each after what stands before it."""
    closed, parts, at = [w if w == ctw.END else w + ctw.START for w in words], [], 0
    for i, n in enumerate(tokens.tolist()):
        parts.append(pasts[ctw.DEPTH * i:ctw.DEPTH * (i + 1)])
        parts.append(b"".join(map(closed.__getitem__, slots[at:at + n].tolist())))
        at += n
    return b"".join(parts)


def lots(stream: bytes, tokens: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, bytes]]:
    """Runs of about ``LOT_WORDS`` words in whole rows, and their part of ``stream``."""
    ends, lot = np.concatenate([[0], np.cumsum(sizes + ctw.DEPTH)]), np.cumsum(tokens) // LOT_WORDS
    starts = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]]))
    for p, q in zip(starts, [*starts[1:], len(tokens)], strict=True):
        yield slice(p, q), stream[ends[p]:ends[q]]


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(schema: str, n: int, /, **columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k]) for c, k in zip(names, kinds, strict=True)], list(names))


def write_blocks(docs: DataFrame, folder: str, held: Column, across: bool, shares: int) -> None:
    """Blocks of ``docs`` (doc_id, text): a row with the documents as word numbers, one for each share of words, one for each share of grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, doc = TaskContext.get().partitionId() << 40, 0, 0
        block = _Block(task, across, shares)
        for batch in batches:
            for doc_id, out, text in ((v.as_py() for v in row) for row in zip(batch["doc_id"], batch["held"], batch["text"], strict=True)):
                last, past = None, ctw.PAST
                for part in chunks(text):
                    if last is not None:
                        past = block.add(task | doc, doc_id, out, last, past)
                        if block.total >= BLOCK_TOKENS:
                            yield from block.batches()
                            number += 1
                            block = _Block(task | number, across, shares)
                    last = part.lower().split()
                block.add(task | doc, doc_id, out, [*last, ctw.END], past)
                doc += 1
                if block.total >= BLOCK_TOKENS:
                    yield from block.batches()
                    number += 1
                    block = _Block(task | number, across, shares)
        if block.rows:
            yield from block.batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), utf8(F.col("text")).alias("text"))
    rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(folder)


# ---- the tree ----

GRAMS = "share int, root int, keys binary, n binary"
TOPS = "root int, ctx int, node int, n0 double, n1 double, weighted double"


def distinct_grams(blocks: DataFrame, shares: int) -> DataFrame:
    """Grams summed over blocks, dealt to ``root`` by their nearest context bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, share = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            share = batch["share"][0].as_py() if batch.num_rows else share
            for k, c in zip(batch["keys"], batch["seen"], strict=True):
                found.append((release_sorted(k.as_py()), release(c.as_py(), "<u8")))
                held += len(found[-1][0])
                if held >= MERGED:
                    keys, n = ctw.merged(*(np.concatenate(x) for x in zip((keys, n), *found, strict=True)))
                    found, held = [], 0
        keys, n = ctw.merged(*(np.concatenate(x) for x in zip((keys, n), *found, strict=True)))
        for root, at in dealt(share_of(keys >> np.uint64(64 - 8 * ctw.TOP), shares)):
            yield _batch(GRAMS, 1, share=[share], root=[root], keys=[squeeze_sorted(keys[at])], n=[squeeze(n[at])])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return blocks.where("keys is not null").select("share", "keys", "seen").groupBy("share").applyInArrow(run, GRAMS)


def _subtrees(batches: list[tuple[bytes, bytes]]) -> Iterator[ctw.Subtree]:
    """The subtrees of a root, some contexts at a time."""
    keys, n = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*((release_sorted(k), release(c, "<u8")) for k, c in batches), strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    for part in ctw.pieces(keys):
        yield ctw.Subtree(keys[part], n[part])


def top_nodes(grams: DataFrame) -> DataFrame:
    """Nodes of ``ctw.TOP`` context bytes with what lies below them."""

    def run(group: pa.Table) -> pa.Table:
        tops = [tree.top() for tree in _subtrees(list(zip(group["keys"].to_pylist(), group["n"].to_pylist(), strict=True)))]
        top = {c: np.concatenate([t[c] for t in tops]) for c in tops[0]}
        root = np.full(len(top["ctx"]), group["root"][0].as_py())
        return pa.table({"root": pa.array(root, pa.int32()), "ctx": pa.array(top["ctx"], pa.int32()), "node": pa.array(top["node"], pa.int32()),
                         **{c: top[c] for c in ("n0", "n1", "weighted")}})

    return grams.select("root", "keys", "n").groupBy("root").applyInArrow(run, TOPS)


def _weighed() -> Column:
    def run(n0: pd.Series, n1: pd.Series, below: pd.Series) -> pd.DataFrame:
        weighted, weight = ctw.weigh(n0.to_numpy(), n1.to_numpy(), below.to_numpy())
        return pd.DataFrame({"weighted": weighted, "weight": weight})

    run.__annotations__ = {"n0": pd.Series, "n1": pd.Series, "below": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "weighted double, weight double")("n0", "n1", "below")


def mixtures(tops: DataFrame) -> DataFrame:
    """``root, ctx, node, fixed, share`` of the nodes of ``ctw.TOP`` bytes: what shorter contexts say of a 1."""
    levels, below = [], tops
    for _ in range(ctw.TOP):
        level = below.groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        below = stored(level.withColumn("_w", _weighed()).select("ctx", "node", "n0", "n1", "_w.*"), "level")
        levels.append(below)
    own = F.col("weight") * (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    paths = levels[-1].select("ctx", "node", own.alias("fixed"), (1 - F.col("weight")).alias("rest"))
    for level in reversed(levels[:-1]):
        up = paths.withColumnRenamed("ctx", "up")
        paths = level.withColumn("up", F.shiftright("ctx", 8)).join(up, ["up", "node"]).select(
            "ctx", "node", (F.col("fixed") + F.col("rest") * own).alias("fixed"), (F.col("rest") * (1 - F.col("weight"))).alias("rest"))
    up = paths.withColumnRenamed("ctx", "up")
    return tops.select("root", "ctx", "node", F.shiftright("ctx", 8).alias("up")).join(up, ["up", "node"]).select("root", "ctx", "node", "fixed", "rest")


def gram_scores(grams: DataFrame, mixed: DataFrame, shares: int) -> DataFrame:
    """``share, keys, scores``: log probabilities of grams, dealt by hash again."""

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        rows = list(zip(group["keys"].to_pylist(), group["n"].to_pylist(), strict=True))
        if not rows:
            return pa.table({"share": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
        names = above["ctx"].to_numpy().astype(np.int64) << 8 | above["node"].to_numpy().astype(np.int64)
        order = np.argsort(names)
        names, fixed, rest = names[order], above["fixed"].to_numpy()[order], above["rest"].to_numpy()[order]
        found = [(tree.keys[0], tree.log10(names, fixed, rest)) for tree in _subtrees(rows)]
        keys, scores, out = *(np.concatenate(x) for x in zip(*found, strict=True)), []
        for share, at in dealt(gram_share(keys, shares)):
            out.append((share, squeeze_sorted(keys[at]), squeeze(scores[at].astype("<f4"))))
        share, packed, values = zip(*out, strict=True)
        return pa.table({"share": pa.array(share, pa.int32()), "keys": pa.array(packed, pa.binary()), "scores": pa.array(values, pa.binary())})

    below = grams.select(F.col("root").alias("of"), "keys", "n").groupBy("of")
    return below.cogroup(mixed.groupBy("root")).applyInArrow(run, "share int, keys binary, scores binary")


def block_scores(blocks: DataFrame, scores: DataFrame) -> DataFrame:
    """``of, share, scores``: what the grams that a block asked for are worth, in their order."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        found = [(release_sorted(k), release(s, "<f4")) for k, s in zip(known["keys"].to_pylist(), known["scores"].to_pylist(), strict=True)]
        keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)])
        values = np.concatenate([np.zeros(0, "<f4"), *(s for _, s in found)])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = [squeeze(values[np.searchsorted(keys, release_sorted(k))]) for k in asked["keys"].to_pylist()]
        return pa.table({"of": asked["block"], "share": asked["share"], "scores": pa.array(out, pa.binary())})

    asked = blocks.where("keys is not null").select("block", "share", F.col("share").alias("at"), "keys")
    return asked.groupBy("at").cogroup(scores.groupBy("share")).applyInArrow(answer, "of long, share int, scores binary")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written and read again: as Parquet rows take a small part of what they do in a checkpoint."""
    folder, schema = shared_folder(df.sparkSession, purpose), df.schema
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder)


def gram_model(blocks: DataFrame, shares: int) -> DataFrame:
    """``of, share, scores``: log10 probabilities of each block's grams under the tree of all blocks."""
    grams = stored(distinct_grams(blocks, shares), "grams")
    return block_scores(blocks, gram_scores(grams, mixtures(stored(top_nodes(grams), "tops")), shares))


# ---- scores ----

def word_counts(blocks: DataFrame) -> DataFrame:
    """``of, share, c``: how often training texts hold the words that a block dealt to a share, in their order.

    One row a share says how many words are ``known``, and their ``total``.
    """

    def run(group: pa.Table) -> pa.Table:
        index: dict[bytes, int] = defaultdict(count().__next__)
        slots = [np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                 for words in (zstandard.decompress(raw).split(ctw.START) for raw in group["listed"].to_pylist())]
        c = np.zeros(len(index), np.int64)
        for at, raw in zip(slots, group["times"].to_pylist(), strict=True):
            c[at] += release(raw, "<i8")  # a block lists a word once
        first = np.arange(group.num_rows) == 0
        return pa.table({"of": group["block"], "share": group["share"], "c": pa.array([squeeze(c[at].astype("<i8")) for at in slots], pa.binary()),
                         "known": np.where(first, np.count_nonzero(c), 0), "total": np.where(first, c.sum(), 0)})

    dealt_words = blocks.where("listed is not null").select("block", "share", "listed", "times")
    return dealt_words.groupBy("share").applyInArrow(run, "of long, share int, c binary, known long, total long")


def _along(stream: bytes, tokens: np.ndarray, sizes: np.ndarray, across: bool, shares: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Scores of a block's rows, from those of its distinct grams by share."""
    own = np.zeros(0, np.uint64)
    for i, (rows, part) in enumerate(lots(stream, tokens, sizes)):
        own = np.concatenate([own, ctw.distinct(ctw.text_grams(part, sizes[rows], across))[0]])
        own = ctw.runs(np.sort(own, kind="stable"))[0] if i % 4 == 3 else own
    own = ctw.runs(np.sort(own, kind="stable"))[0]
    values, at = np.zeros(len(own), "<f4"), dict(dealt(gram_share(own, shares)))
    for share, raw in answers:
        values[at[share]] = release(raw, "<f4")
    del at
    own *= _SPREAD
    order = np.argsort(own)
    own, values, out = own[order], values[order], np.zeros(len(sizes))
    del order
    opens, shift = openings(own)
    for rows, part in lots(stream, tokens, sizes):
        each = values[places(own, opens, shift, ctw.text_grams(part, sizes[rows], across) * _SPREAD)]
        out[rows] = np.bincount(np.repeat(np.arange(rows.stop - rows.start), sizes[rows]), each, rows.stop - rows.start)
    return out


def openings(spread: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """How many of the sorted ``spread`` keys lie before each value of the first bits, and the shift that leaves these."""
    bits = len(spread).bit_length() + 1
    shift = np.uint64(64 - bits)
    n = np.bincount((spread >> shift).astype(np.int64), minlength=1 << bits)
    return (np.cumsum(n) - n).astype(np.uint32), shift


def places(spread: np.ndarray, opens: np.ndarray, shift: np.uint64, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in ``spread``, which holds them all: a few steps from the opening, a search for those that lie further."""
    at = opens[keys >> shift]
    left = np.flatnonzero(spread[at] != keys)
    for _ in range(4):
        at[left] += np.uint32(1)
        left = left[spread[at[left]] != keys[left]]
    at[left] = np.searchsorted(spread, keys[left])
    return at


RESULT = "doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def score_documents(docs: DataFrame, held: Column, across: bool = False) -> DataFrame:
    """Scores of ``docs`` (doc_id, text), the model learned from those that are not ``held``.

    Contexts run ``across`` words to the start of the text, or back to the start of the
    word. ``code_length`` is in bits a byte of the words, blanks and end.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(2))).first()[0] or 0
    shares = 1 + size // (2 * SHARE_BYTES)
    # Many small partitions would make as many small blocks, which hold few grams twice.
    write_blocks(docs.coalesce(1 + size // BLOCK_BYTES), folder := shared_folder(spark, "blocks"), held, across, shares)
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    counted = stored(word_counts(blocks), "words")
    known, total = counted.agg(F.sum("known"), F.sum("total")).first()
    known, total = known or 0, total or 0
    space = float(total + known + 1)

    def add_up(rows: pa.Table, met: pa.Table) -> pa.Table:
        row = {k: release(rows[k][0].as_py(), kind) for k, kind in (
            ("docs", "<i8"), ("doc_ids", "<i8"), ("absent", "u1"), ("held", "u1"), ("tokens", "<i8"), ("sizes", "<i8"), ("slots", "<u4"))}
        words = zstandard.decompress(rows["words"][0].as_py()).split(ctw.START)
        c, places = np.zeros(len(words), np.int64), dict(dealt(word_share(words, shares)))
        for share, raw in zip(met["share"].to_pylist(), met["c"].to_pylist(), strict=True):
            if raw is not None:
                c[places[share]] = release(raw, "<i8")
        base, seen = np.log10((c + 1) / space), c > 0
        of = np.repeat(np.arange(len(row["tokens"])), row["tokens"])
        added = lambda values: np.bincount(of, values[row["slots"]], len(row["tokens"]))
        answers = [(share, raw) for share, raw in zip(met["share"].to_pylist(), met["scores"].to_pylist(), strict=True) if raw is not None]
        stream = stream_of(words, row["slots"], row["tokens"], zstandard.decompress(rows["pasts"][0].as_py()))
        score = _along(stream, row["tokens"], row["sizes"], across, shares, answers)
        return pa.table({
            "doc": row["docs"], "doc_id": pa.array(row["doc_ids"], pa.int64(), mask=row["absent"].astype(bool)), "held_out": row["held"].astype(bool),
            "n_tokens": row["tokens"], "n_known": added(seen).astype(np.int64), "base_score": added(base), "score": score, "n_bytes": row["sizes"]})

    met = counted.select("of", "share", "c").unionByName(gram_model(blocks, shares), allowMissingColumns=True)
    rows = blocks.where("docs is not null").select("block", "docs", "doc_ids", "absent", "held", "tokens", "sizes", "slots", "words", "pasts")
    parts = rows.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(add_up, RESULT)
    whole = parts.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(
        F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
                        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("code_length"))


def op11_context_tree(spark, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a tree learned from the training folds."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, across=True)
