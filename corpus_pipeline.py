"""A corpus pipeline: language, host quality, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.
"""

from pyspark.sql import DataFrame, SparkSession

from labelscope.llm.common import table
from labelscope.llm.langid import stage_language
from labelscope.llm.near_dup import stage_near_dup
from labelscope.llm.packing import stage_packing
from labelscope.llm.quality import stage_quality
from labelscope.session import shared_folder

STAGES = [
    ("language ID", stage_language),
    ("quality rules", stage_quality),
    ("MinHash near-dedup", stage_near_dup),
    ("packing", stage_packing),
]

#: A learned model and packing by arrival have no SQL; tests hold each stage against its operator and the packed ids against the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each read from what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(folder := shared_folder(spark, "stage"))
            docs = spark.read.parquet(folder)
    return docs
