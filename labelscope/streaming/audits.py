"""The same audits on a stream: no state, watermark or shuffle is involved."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelscope.operators import topology
from labelscope.sources.documents import decode_traces, line_key, numbered


def stream_trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-line traces as they arrive, decoded and coded."""
    lines = spark.readStream.format("text").load(path)
    return decode_traces(lines.select(
        line_key(F.col("value")).alias("record_key"), F.col("value").cast("binary").alias("payload"),
        F.lit(False).alias("oversize")))


def write_trace_audits(coded: DataFrame, reports: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Append reports of valid rows and codes of rejects, batch by batch."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        audits = topology.audit_traces(batch.where(F.col("error_code").isNull()))
        # A batch folder is replaced when a batch is retried.
        topology.audit_report_json(audits).write.mode("overwrite").json(f"{reports}/batch={batch_id}")
        batch.where(F.col("error_code").isNotNull()).select(
            numbered(F.col("record_key")).alias("record_key"), "error_code").write.mode(
            "overwrite").json(f"{rejects}/batch={batch_id}")
        batch.unpersist()

    return (coded.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
