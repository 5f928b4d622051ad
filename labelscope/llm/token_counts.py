"""Delta-maintained token-count rollups.

A change batch holds signed document events: ``insert``, ``delete``, and
``revise`` for a new count of a document already there (new text or another
tokenizer). ``Rollup.commit`` turns a batch into additive deltas of documents and
tokens by source, language and tokenizer version, against the documents that are
live before it, and writes both to the folder of the batch's id. A batch that is
committed again replaces its own folder with the same rows, so totals do not
change: a lost driver may run it again. ``totals`` adds the deltas up; no
document is counted anew.

Defined results: NULL source or language is a group of its own; a NULL text counts
as empty; deleting or revising what is not live, and inserting what is, changes
nothing beyond it (an insert of a live document is a revision); of equal keys in a
batch the event with the largest ``seq`` holds, and events of equal ``seq`` give
way to the one with more tokens; events without doc_id are counted as documents
of their own and cannot be changed. Groups whose sums are zero are not listed.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.llm.common import table
from labelscope.session import shared_folder

KEY = ("doc_id", "version")
GROUP = ("source", "lang", "version")
LIVE = "doc_id long, version string, source string, lang string, tokens long, sign int"
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"

#: Token counts as column expressions: white-space words, words and signs, UTF-8 bytes with an end id.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))),
    "words-2": lambda text: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"), F.lit(0))),
    "bytes-1": lambda text: F.octet_length(F.coalesce(text, F.lit(""))) + 1,
}


def events(docs: DataFrame, op: str, version: str, seq: int = 0) -> DataFrame:
    """One event per row of ``docs`` (doc_id, text, source, lang) under a tokenizer."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(version).alias("version"), "source", "lang",
        TOKENIZERS[version](F.col("text")).cast("long").alias("tokens"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, part: str, schema: str, batches: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{part}/{b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def live(self, batches: list[str]) -> DataFrame:
        """Counted documents after ``batches``: signed rows of one document add up."""
        rows = self._read("live", LIVE, batches)
        return rows.groupBy(*KEY, "source", "lang", "tokens").agg(F.sum("sign").alias("sign")).where("sign > 0")

    def commit(self, batch: str, changes: DataFrame, before: list[str]) -> None:
        """Commit ``changes`` as ``batch``, after the batches named in ``before``."""
        last = Window.partitionBy(*KEY).orderBy(F.desc("seq"), F.desc("tokens"), "source", "lang", "op")
        named = changes.where("doc_id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        # Deleted and revised rows leave with the counts and groups they came with.
        old = self.live(before).where("doc_id is not null").select(*KEY, F.struct("source", "lang", "tokens").alias("old"))
        met = named.join(old, list(KEY), "left")
        known = F.col("old").isNotNull()
        gone = met.where(known & F.col("op").isin("delete", "revise", "insert")).select(*KEY, "old.source", "old.lang", "old.tokens", F.lit(-1).alias("sign"))
        come = met.where((F.col("op") == "insert") | (F.col("op") == "revise") & known).select(*KEY, "source", "lang", "tokens", F.lit(1).alias("sign"))
        nameless = changes.where("doc_id is null and op = 'insert'").select(*KEY, "source", "lang", "tokens", F.lit(1).alias("sign"))
        gone.unionByName(come).unionByName(nameless).write.mode("overwrite").parquet(f"{self.folder}/live/{batch}")
        signed = self._read("live", LIVE, [batch])
        signed.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens")
        ).write.mode("overwrite").parquet(f"{self.folder}/deltas/{batch}")

    def totals(self, batches: list[str]) -> DataFrame:
        return self._read("deltas", DELTAS, batches).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def op5_token_rollups(spark, sf_dir: str) -> DataFrame:
    """Totals after all documents came, a tenth went, and every language but English was counted anew.

    The second batch is committed twice, as after a lost driver.
    """
    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, shared_folder(spark, "rollup"))
    removed = events(docs.where("doc_id % 10 = 3"), "delete", "words-1")
    rollup.commit("b1", events(docs, "insert", "words-1").unionByName(events(docs, "insert", "bytes-1")), [])
    rollup.commit("b2", removed, ["b1"])
    rollup.commit("b2", removed, ["b1"])
    moved = docs.where("lang <> 'en'")
    revised = events(moved.withColumn("text", F.concat("text", F.lit(" again"))), "revise", "bytes-1").unionByName(events(moved, "insert", "words-2"))
    rollup.commit("b3", revised, ["b1", "b2"])
    return rollup.totals(["b1", "b2", "b3"])


OP5_SQL = r"""
WITH t AS (SELECT *, coalesce(text, '') AS body FROM documents),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS tokens FROM t WHERE doc_id % 10 <> 3
  UNION ALL SELECT source, lang, 'words-2', len(regexp_extract_all(body, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) FROM t WHERE lang <> 'en'
  UNION ALL SELECT source, lang, 'bytes-1', 1 + octet_length(encode(CASE WHEN lang <> 'en' THEN coalesce(text || ' again', '') ELSE body END)) FROM t)
SELECT source, lang, version, count(*) AS n_docs, sum(tokens)::BIGINT AS n_tokens FROM counted GROUP BY source, lang, version
"""
