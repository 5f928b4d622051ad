"""Parquet rows, file inventories, manifests and report sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.sources.files import opens, read_files

#: A value holds no more bytes; larger files are listed without their content.
MAX_CONTENT_BYTES = (1 << 31) - 1024


def read_sft(spark: SparkSession, path: str) -> DataFrame:
    """``instruction, output`` training rows."""
    return spark.read.schema(S.SFT_ROWS).parquet(path)


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its file system, as Spark resolves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, bytes, git_mode`` of every file below ``root``, as the file system lists them.

    Spark's scans leave out empty files and names that start with ``_`` or ``.``;
    this listing has them. Only names and sizes pass the driver, as they do when a
    scan is planned. Where a catalogue of the files exists, hand that to the
    readers instead.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    rows = []
    while files.hasNext():
        status = files.next()
        mode = "100755" if status.getPermission().toString()[2] == "x" else "100644"
        rows.append((status.getPath().toString(), status.getLen(), mode))
    return spark.createDataFrame(rows, "path string, bytes long, git_mode string")


def scan_files(spark: SparkSession, root: str, max_bytes: int, listing: DataFrame | None = None) -> DataFrame:
    """``path, bytes, content`` (and other columns of ``listing``) of every listed file.

    Content is NULL for files over ``max_bytes``, whose bytes are never read, and
    for hidden files, which no scan reads. Without a listing executors list and read
    what ``pyarrow.fs`` opens; other stores are listed and scanned by Spark.
    """
    if listing is None and opens(at := qualified(spark, root)):
        return read_files(spark, at, max_bytes)
    listed = list_files(spark, root) if listing is None else listing
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(
        F.col("length") <= max_bytes).select("path", "content")
    empty = F.when(F.col("bytes") == 0, F.lit("").cast("binary"))
    return listed.join(found, "path", "left").withColumn("content", F.coalesce("content", empty))


def scan_inventory(spark: SparkSession, root: str, max_bytes: int = MAX_CONTENT_BYTES, listing: DataFrame | None = None) -> DataFrame:
    """``path, bytes, git_mode, content`` of every file below ``root``; paths relative to it."""
    base = root.rstrip("/") + "/"
    return scan_files(spark, root, max_bytes, listing).withColumn("path", F.substring_index("path", base, -1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file listed in the JSON manifests of ``path`` that meet the contract; ``documents.read_manifests`` has the rejects."""
    from labelscope.sources.documents import read_manifests  # it reads files through this module

    return read_manifests(spark, path)[0].drop("record_key")


def write_reports(reports: DataFrame, path: str, run_id: str, compression: str = "none") -> str:
    """Write canonical ``report`` lines below a new run folder; ``compression`` is one that text files can have.

    An existing run is refused, and the commit protocol publishes a run only
    when all its tasks finish, so earlier output is never touched.
    """
    target = f"{path.rstrip('/')}/run={run_id}"
    reports.select(F.col("report").alias("value")).write.mode("errorifexists").text(target, compression=compression)
    return target


def write_sweep_csv(table: DataFrame, path: str) -> None:
    """Sweep rows as CSV; a NULL cutoff is an empty cell."""
    table.write.mode("errorifexists").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
