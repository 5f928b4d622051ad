"""Session defaults and lineage cutting that survives executor loss."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of ``spark``, once per context."""
    context = spark.sparkContext
    if not getattr(context, "_labelscope_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="labelscope-")) / "labelscope.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._labelscope_shipped = True
    return spark


def local_session(cores: str = "8", app: str = "labelscope", shuffle_partitions: int = 8) -> SparkSession:
    """A single-node session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Audits multiply their input's bytes: a small partition is worth a task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="labelscope-")
    return f"{folder.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. A machine-local folder
    is set only when none is configured and the master is local.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="labelscope-"))
    return df.checkpoint(eager=True)
