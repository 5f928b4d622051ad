"""The training recipe under audit: prompts, length-cutoff labels, padded batches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.bpe import BpeTokenizer
from labelscope.functions.text import PromptTemplate


def render_pairs(rows: DataFrame, template: PromptTemplate = PromptTemplate()) -> DataFrame:
    """``instruction, output`` to ``source, target``."""
    return rows.withColumns({
        "source": template.prompt(F.col("instruction")),
        "target": template.target(F.col("output")),
    })


def tokenize(df: DataFrame, columns: dict[str, str], tokenizer: BpeTokenizer, max_length: int) -> DataFrame:
    """Ids of each text, prefix token first, truncated on the right.

    ``columns`` maps a text column to the ids column to add.
    """
    out = df.withColumns({f"_{ids}_pieces": tokenizer.pieces(F.col(text)) for text, ids in columns.items()})
    prefix = F.array(F.lit(tokenizer.bos_id).cast("bigint"))
    out = out.withColumns({
        ids: F.slice(F.concat(prefix, tokenizer.ids(F.col(f"_{ids}_pieces"))), F.lit(1), F.lit(max_length))
        for ids in columns.values()
    })
    return out.drop(*[f"_{ids}_pieces" for ids in columns.values()])


def token_lengths(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``columns`` maps an ids column to the length column to add."""
    return df.withColumns({name: F.size(ids) for ids, name in columns.items()})


def mask_by_source_length(input_ids: Column, source_length: Column) -> Column:
    """Labels that ignore the first ``source_length`` positions."""
    return F.transform(input_ids, lambda t, i: F.when(i < source_length, S.IGNORE_INDEX).otherwise(t))


def preprocess_pairs(
    pairs: DataFrame, tokenizer: BpeTokenizer, max_length: int = 512, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``source, target`` to ``input_ids, labels``; other columns go unless kept."""
    rows = pairs.select(*keep, "source", F.concat("source", "target").alias("_example"))
    rows = tokenize(rows, {"_example": "input_ids", "source": "_source_ids"}, tokenizer, max_length)
    return rows.select(
        *keep, "input_ids", mask_by_source_length(F.col("input_ids"), F.size("_source_ids")).alias("labels"))


def assign_batches(
    rows: DataFrame, order: str | tuple[str, ...], batch_size: int, shard_width: int = 1 << 20, shard: Column | None = None
) -> DataFrame:
    """Adds ``shard`` and ``batch``: consecutive rows of ``order`` in equal batches.

    ``order`` is a unique integer, or several columns that are unique together.
    A shard is a range of ``shard_width`` values of the one, or what ``shard``
    says of the several; no global sort is needed. Each shard closes with one
    possibly short batch.
    """
    order = (order,) if isinstance(order, str) else order
    sharded = rows.withColumn("shard", F.floor(F.col(order[0]) / shard_width) if shard is None else shard)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(*order)) - 1
    return sharded.withColumn("batch", F.floor(rank / batch_size))


def pad_collate(batched: DataFrame, pad_id: int) -> DataFrame:
    """Right-pad ids and labels to the longest row of their batch."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("shard", "batch"))
    rows = batched.withColumn("_gap", longest - F.size("input_ids"))
    pad = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value).cast("bigint"), F.col("_gap")))
    return rows.withColumns({"input_ids": pad("input_ids", pad_id), "labels": pad("labels", S.IGNORE_INDEX)}).drop("_gap")


def attention_mask(input_ids: Column, pad_id: int) -> Column:
    """True where the id is not the pad id, even for a real token that equals it."""
    return F.transform(input_ids, lambda t: t != pad_id)


def sample_examples(rows: DataFrame, key: str, n: int = 3, seed: str = "0") -> DataFrame:
    """A repeatable sample of ``n`` rows: the lowest seeded key hashes."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))), key).limit(n)
