"""Places in the order of a whole table, and batches that follow it.

A table's order is cut into ranges, rows are counted range by range, and the
counts of earlier ranges are added to each row's place in its own. Ranges are cut
on all columns of the order, so many rows that share the first one spread as well.
Sums over the ranges go in two steps; no task sees more than one row for every
``FAN`` ranges, or ``FAN`` of them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.session import reliable_checkpoint

#: Ranges whose counts are added up in one task.
FAN = 1024
#: Bits of a row's place within its partition, as ``monotonically_increasing_id`` lays them out.
_LOCAL_BITS = 33


def running_before(counts: DataFrame, key: str, count: str) -> DataFrame:
    """``key, before``: the sum of ``count`` over smaller values of the integer ``key``."""
    grouped = counts.select(F.col(key).alias("_key"), F.floor(F.col(key) / FAN).alias("_group"), F.col(count).alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("_group").agg(F.sum("_n").alias("_n"))
    heads = groups.select("_group", earlier(Window.orderBy("_group")).alias("_head"))
    inside = grouped.select("_key", "_group", earlier(Window.partitionBy("_group").orderBy("_key")).alias("_own"))
    return inside.join(heads, "_group").select(F.col("_key").alias(key), (F.col("_head") + F.col("_own")).alias("before"))


def with_places(rows: DataFrame, order: tuple[str | Column, ...], place: str = "place") -> DataFrame:
    """Adds each row's number, from 0, in ``order`` (unique together; NULLs first).

    Range borders are sampled anew whenever a plan runs, so the ranges are written
    once, each row with its place in them, before they are counted.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = reliable_checkpoint(ranged.withColumn("_at", F.monotonically_increasing_id()))
    block = F.shiftright("_at", _LOCAL_BITS).alias("_block")
    counts = kept.select(block).groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
    starts = running_before(counts, "_block", "_rows")
    own = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return kept.withColumn("_block", block).join(starts, "_block").withColumn(place, F.col("before") + own).drop("_block", "_at", "before")


def dataset_batches(rows: DataFrame, order: tuple[str | Column, ...], batch_size: int) -> DataFrame:
    """Adds ``place`` and ``batch``: runs of ``batch_size`` rows in ``order``, of which only the table's last may be shorter."""
    if batch_size < 1:
        raise ValueError("a batch holds one row or more")
    return with_places(rows, order).withColumn("batch", F.floor(F.col("place") / batch_size))
