"""A user's function over batches of exactly n rows.

Arrow batches are cut by Spark's settings; here they are cut again, so that a
function sees ``batch_size`` rows at a time whatever those are. What it returns
replaces the rows it was given, under a declared schema, and may be more or fewer.
"""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.operators.ordering import dataset_batches

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


def recut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last one perhaps shorter; nothing is copied until it is full."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _checked(given: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    missing = [c for c in names if c not in given.columns]
    if missing:
        raise ValueError(f"the function returned no column {', '.join(missing)}")
    return given[names]


def batched_map(rows: DataFrame, function: BatchFunction, batch_size: int, schema: str | T.StructType) -> DataFrame:
    """``function`` over runs of ``batch_size`` rows of each partition; a partition's last run may be shorter.

    There is no exchange: partitions are what a process pool is elsewhere.
    """
    if batch_size < 1:
        raise ValueError("a batch holds one row or more")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for table in recut(batches, batch_size):
            yield _checked(function(table.to_pandas()), declared.names)

    return rows.mapInArrow(_as_arrow(run, declared), declared)


def _as_arrow(run, declared: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(declared)
        for frame in run(batches):
            yield from pa.Table.from_pandas(frame, kinds, preserve_index=False).to_batches()

    return arrow


def ordered_map(
    rows: DataFrame, order: tuple[str | Column, ...], function: BatchFunction, batch_size: int, schema: str | T.StructType
) -> DataFrame:
    """The same over batches that follow ``order`` through the whole table: only its last may be shorter."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, columns = declared.names, rows.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _checked(function(group.sort_values("_place")[columns].reset_index(drop=True)), names)

    placed = dataset_batches(rows, order, batch_size).withColumnsRenamed({"place": "_place", "batch": "_batch"})
    return placed.groupBy(F.col("_batch")).applyInPandas(run, declared)
