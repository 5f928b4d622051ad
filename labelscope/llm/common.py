"""Shared parts: whole-text bytes, bounded word tables, checkpoints, row checks.

Every operator reads a NULL text as an empty one, reads only the columns it
names, and leaves whatever else a table carries alone.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import reliable_checkpoint, ship_package

#: Words of one block of documents that a task scores at once.
BLOCK_WORDS = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(text: Column) -> Column:
    """Whole text as UTF-8 bytes; NULL is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    return reliable_checkpoint(df)


def even_share(key: Column) -> Column:
    """A number in [0, 1) fixed by ``key``."""
    return (F.xxhash64(key).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))).cast("double")


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks: the latest one thing, so that
    tables of different operators never stand beside each other."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class WordTable:
    """Values of distinct words, computed once while they stay in the table.

    ``compute`` gives one row of values for each new word. Past ``limit`` words
    the table starts anew, so it is bounded however many words a task meets.
    """

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self.index: dict[bytes, int] = {}
        self.rows: np.ndarray | None = None

    def values(self, words: Sequence[bytes]) -> np.ndarray:
        at = self.ids(words)  # may renew the rows
        return self.rows[at]

    def ids(self, words: Sequence[bytes]) -> np.ndarray:
        known = self.index
        new = list({w for w in words if w not in known})
        if new or self.rows is None:
            if len(self.index) + len(new) > self.limit:
                self.index, self.rows, new = {}, None, list(set(words))
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _add(self, new: list[bytes]) -> None:
        fresh, start = self.compute(new), len(self.index)
        need = start + len(new)
        if self.rows is None:
            self.rows = np.zeros((max(1024, need), *fresh.shape[1:]), fresh.dtype)
        elif need > len(self.rows):
            grown = np.zeros((2 * need, *fresh.shape[1:]), fresh.dtype)
            grown[:start] = self.rows[:start]
            self.rows = grown
        self.rows[start:need] = fresh
        self.index.update(zip(new, range(start, need), strict=True))


def blocks(texts: Sequence[bytes], split: Callable[[bytes], list[bytes]]) -> Iterator[tuple[list[list[bytes]], np.ndarray]]:
    """Runs of documents as word lists, with the place of each first word.

    A block holds about ``BLOCK_WORDS`` words, or one longer document.
    """
    held, total = [], 0
    for text in texts:
        held.append(words := split(text))
        total += len(words)
        if total >= BLOCK_WORDS:
            yield held, _starts(held)
            held, total = [], 0
    if held:
        yield held, _starts(held)


def _starts(held: list[list[bytes]]) -> np.ndarray:
    return np.cumsum([0, *map(len, held)])


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``; an empty run gives 0."""
    running = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=running[1:])
    return running[starts[1:]] - running[starts[:-1]]
