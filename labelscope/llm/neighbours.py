"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised on their own, so K codewords a half make
K x K cells. A query walks centroid pairs by summed distance with a heap: the
distance of a half is how far the codeword's inner product stays behind the best
codeword's. It stops once the cells hold ``share`` of all entries (``least`` at
least), and the entries met are ranked anew by inner product in double precision.

Codebooks are fitted on a bounded sample (about ``SAMPLE`` vectors); every vector
is indexed. Equal vectors are one entry with their smallest ids, of which a query
can return no more than ``TOP`` + 1. Cells are gathered into groups of about
``GROUP`` entries, a larger cell being split, so no cell meets in one task.

Defined results: vectors that are NULL, zero, of another length than most, or
hold NULL or non-finite components take no part; ties go to smaller ids; a row
without an id takes no part; an empty table has no neighbours. Rows that repeat an
id with the same vector are one vector.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import cut, even_share, table

TOP = 20
CODEWORDS = 64
SAMPLE = 20_000
#: Entries that a query ranks: this share of all, and no fewer than LEAST. Vectors
#: without clusters need a large share for a recall of 0.9 (README).
SHARE, LEAST = 0.5, 2000
GROUP = 4096
_FOUND = "query long, entry long, score double"


@dataclass(frozen=True)
class Index:
    halves: tuple[np.ndarray, np.ndarray]  # codewords of each half
    counts: np.ndarray  # entries of each cell
    group: np.ndarray  # group of each cell
    parts: np.ndarray  # parts of each group

    @property
    def codewords(self) -> int:
        return len(self.halves[0])


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold ``wanted`` entries."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    k, held, cells = len(a), 0, []
    heap = [(float(first[a[0]] + second[b[0]]), 0, 0)]
    next_row = 1
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        # A row's next pair follows its last; a new row opens with the pair above it.
        if j + 1 < k:
            heapq.heappush(heap, (float(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and next_row < k:
            heapq.heappush(heap, (float(first[a[next_row]] + second[b[0]]), next_row, 0))
            next_row += 1
    return cells


def codebook(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """K-means codewords; a codeword without points keeps its place."""
    draw = np.random.default_rng(7)
    centres = points[draw.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = sound.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return sound.where(F.size("v") == (length["n"] if length else 0))


def build(entries: DataFrame, codewords: int, sample: int) -> Index | None:
    """Codebooks from a sample of ``entries`` (entry, v), cells and groups from all."""
    total = entries.count()
    if not total:
        return None
    some = np.array(entries.where(even_share(F.col("entry")) < max(1.0, sample) / total).select("v").toPandas()["v"].tolist() or [entries.first()["v"]])
    middle, k = some.shape[1] // 2, min(codewords, len(some))
    halves = (codebook(some[:, :middle], k), codebook(some[:, middle:], k))
    counts = np.zeros(k * k, np.int64)
    for row in entries.groupBy(cell_column(entries.sparkSession, halves, F.col("v")).alias("cell")).agg(F.count("*").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    group, parts, held = np.zeros(k * k, np.int64), [1], 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > GROUP:
            parts.append(1)
            held = 0
        group[cell] = len(parts) - 1
        held += n
        parts[-1] = max(1, -(-held // GROUP))
    return Index(halves, counts, group, np.array(parts))


def cell_column(spark, halves: tuple[np.ndarray, np.ndarray], v: Column) -> Column:
    shared = spark.sparkContext.broadcast(halves)

    @F.pandas_udf("long")
    def cell(vectors: pd.Series) -> pd.Series:
        first, second = shared.value
        if not len(vectors):
            return pd.Series([], dtype="int64")
        x, middle = np.array(vectors.tolist()), first.shape[1]
        return pd.Series(nearest(x[:, :middle], first) * len(first) + nearest(x[:, middle:], second))

    return cell(v)


def top_of(scores: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best scores, ties to smaller names."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > most:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((names[at], -scores[at]))][:most]


def probes(queries: DataFrame, index: Index, wanted: int) -> DataFrame:
    """``grp, part, query, v, cells``: what each group is asked for."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = shared.value
        for batch in batches:
            rows = []
            for name, v in zip(batch["entry"].to_pylist(), batch["v"].to_pylist(), strict=True):
                x, middle = np.array(v), known.halves[0].shape[1]
                first, second = known.halves[0] @ x[:middle], known.halves[1] @ x[middle:]
                asked: dict[int, list[int]] = {}
                for cell in walk(first.max() - first, second.max() - second, known.counts, wanted):
                    asked.setdefault(int(known.group[cell]), []).append(cell)
                rows += [(g, part, name, v, cells) for g, cells in asked.items() for part in range(int(known.parts[g]))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)],
                    ["grp", "part", "query", "v", "cells"])

    return queries.select("entry", "v").mapInArrow(run, "grp long, part long, query long, v array<double>, cells array<long>")


def ranked(entries: DataFrame, queries: DataFrame, index: Index, wanted: int, most: int) -> DataFrame:
    """The ``most`` best entries of each query in each group: ``query, entry, score``."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast((index.group, index.parts))

    @F.pandas_udf("struct<grp:long,part:long>")
    def place(cells: pd.Series, names: pd.Series) -> pd.DataFrame:
        group, parts = shared.value
        g = group[cells.to_numpy(int)]
        return pd.DataFrame({"grp": g, "part": names.to_numpy(int) % parts[g]})

    celled = entries.withColumn("cell", cell_column(spark, index.halves, F.col("v")))
    stored = celled.withColumn("_at", place("cell", F.abs(F.xxhash64("entry") % 1_000_003))).select(
        "_at.grp", "_at.part", F.lit(0).alias("kind"), F.col("entry").alias("name"), "v", F.array("cell").alias("cells"))
    asked = probes(queries, index, wanted).select("grp", "part", F.lit(1).alias("kind"), F.col("query").alias("name"), "v", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, vectors, cells = None, [], [], []
        matrix = named = celled = None
        for batch in batches:
            found = []
            for g, part, kind, name, v, own in zip(*(batch[c].to_pylist() for c in ("grp", "part", "kind", "name", "v", "cells")), strict=True):
                if (g, part) != group:
                    group, names, vectors, cells, matrix = (g, part), [], [], [], None
                if kind == 0:
                    names.append(name)
                    vectors.append(v)
                    cells.append(own[0])
                    continue
                if matrix is None:  # entries come before queries
                    matrix, named, celled = np.array(vectors), np.array(names, np.int64), np.array(cells)
                if len(named):
                    scores = np.where(np.isin(celled, own), matrix @ np.array(v), -np.inf)
                    found += [(name, int(named[i]), float(scores[i])) for i in top_of(scores, named, most)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["query", "entry", "score"])

    met = stored.union(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    return met.mapInArrow(run, _FOUND)


def search(vectors: DataFrame, is_query: Column, top: int = TOP, codewords: int = CODEWORDS, sample: int = SAMPLE,
           share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest other rows of each query row."""
    spark = vectors.sparkSession
    sound = cut(usable(vectors))
    # The top + 1 smallest ids of each vector; the limit is met before rows move.
    smallest = sound.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= top + 1)
    entries = cut(smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "v", "ids"))
    index = build(entries, codewords, sample)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = sound.where(is_query).select("vec_id", "v").distinct().join(entries.select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"))
    asking = entries.join(queries.select(F.col("query").alias("entry")).distinct(), "entry", "left_semi")
    wanted = max(least, int(share * int(index.counts.sum())))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    found = ranked(entries, asking, index, wanted, top + 1).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top + 1)
    spread = found.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return queries.join(spread, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
