"""Drift of very large inventories: buckets are compared by digest, and only unequal ones by name.

A stored inventory is a table of ``name, sha256`` partitioned by ``folder`` and
``bucket`` (two levels of a tree over the hash of the name) beside the digests of
its buckets. A digest does not depend on the order of rows: their number, and sums
and an exclusive or of 64-bit hashes. Where two digests are equal, the buckets are
taken to be equal; rows that differ would have to agree in all four by chance.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.operators.reconcile import golden_drift

#: Folders of the tree, and buckets of each.
FOLDERS = 64
BUCKETS = 64
ROWS = "name string, sha256 string, folder int, bucket int"
DIGEST = ("n", "plain", "mixed", "folded")


def _places(folders: int, buckets: int) -> dict[str, Column]:
    spread = F.pmod(F.xxhash64("name"), F.lit(folders * buckets)).cast("int")
    return {"folder": F.floor(spread / buckets).cast("int"), "bucket": F.pmod(spread, F.lit(buckets)).cast("int")}


def bucket_digests(placed: DataFrame, *level: str) -> DataFrame:
    """Digests of ``placed`` rows by ``level`` columns; a NULL hash differs from every text."""
    own = F.xxhash64("name", F.col("sha256").isNull(), "sha256")
    other = F.xxhash64(F.lit(1), "sha256", "name", F.col("sha256").isNull())
    return placed.groupBy(*level).agg(
        F.count(F.lit(1)).alias("n"), F.sum(own.cast("decimal(38,0)")).alias("plain"), F.sum(other.cast("decimal(38,0)")).alias("mixed"),
        F.bit_xor(own).alias("folded"))


def store_inventory(inventory: DataFrame, path: str, folders: int = FOLDERS, buckets: int = BUCKETS) -> None:
    """Write ``name, sha256`` rows by bucket, and the digests of buckets, below ``path``.

    Inventories that are to be compared have the same numbers of folders and buckets.
    """
    placed = inventory.select("name", "sha256").withColumns(_places(folders, buckets))
    placed.repartition("folder", "bucket").write.partitionBy("folder", "bucket").parquet(f"{path}/rows")
    spark = inventory.sparkSession
    bucket_digests(stored_rows(spark, path), "folder", "bucket").write.parquet(f"{path}/digests")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def _unequal(a: DataFrame, b: DataFrame, *level: str) -> DataFrame:
    """``level`` of digests that are on one side only or differ."""
    side = lambda df, name: df.select(*level, F.struct(*DIGEST).alias(name))
    return side(a, "_a").join(side(b, "_b"), list(level), "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*level)


def unequal_buckets(spark: SparkSession, first: str, second: str) -> list[tuple[int, int]]:
    """Buckets that differ: folders first, then the buckets of unequal folders. At most all there are."""
    digests = [spark.read.parquet(f"{p}/digests") for p in (first, second)]
    sums = [d.groupBy("folder").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"), F.sum("mixed").alias("mixed"), F.bit_xor("folded").alias("folded")) for d in digests]
    folders = [r.folder for r in _unequal(*sums, "folder").collect()]
    if not folders:
        return []
    inside = [d.where(F.col("folder").isin(folders)) for d in digests]
    return sorted((r.folder, r.bucket) for r in _unequal(*inside, "folder", "bucket").collect())


def stored_drift(spark: SparkSession, actual: str, expected: str) -> DataFrame:
    """``name, code`` as ``golden_drift`` says it of the two inventories, reading unequal buckets only."""
    buckets = unequal_buckets(spark, actual, expected)
    wanted: Column = F.lit(False)
    for folder in sorted({f for f, _ in buckets}):
        wanted = wanted | ((F.col("folder") == folder) & F.col("bucket").isin([b for f, b in buckets if f == folder]))
    sides = [stored_rows(spark, p).where(wanted).select("name", "sha256") for p in (actual, expected)]
    return golden_drift(*sides)
