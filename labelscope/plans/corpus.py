"""From turn tables to the shapes the audits read.

``turns`` rows are ``conv_id, turn, role, text``; ``(conv_id, turn)`` is a key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.functions.arrays import let
from labelscope.operators.contract import conversation_code, message_code, validate_traces


#: Ids of over-long conversations are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Turns of a conversation that are ordered in one task.
TURN_BLOCK = 4096


def assemble_conversations(turns: DataFrame) -> DataFrame:
    """``example_id, conv_id, messages, error_code``, one row per conversation.

    Turns are counted first, on the key alone. A conversation past the contract's
    64 messages is a reject with a code and no messages, and its texts never
    move; every other conversation is gathered whole, in one exchange.
    """
    limit = S.MAX_MESSAGES
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long = sizes.where(F.col("n") > limit).select("conv_id")
    found = long.limit(BROADCAST_IDS + 1).count()
    if found:
        ids = long.withColumnRenamed("conv_id", "_long")
        ids = F.broadcast(ids) if found <= BROADCAST_IDS else ids
        turns = turns.join(ids, F.col("conv_id").eqNullSafe(F.col("_long")), "left_anti")
    coded = turns.select("conv_id", F.struct(
        "turn", "role", F.col("text").alias("content"), F.octet_length("text").alias("bytes"),
        message_code(F.col("role"), F.col("text")).alias("code")).alias("m"))
    grouped = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    whole = grouped.select("conv_id", "messages", conversation_code(F.col("messages")).alias("error_code"))
    if found:
        whole = whole.unionByName(long.select("conv_id", F.lit("messages.count").alias("error_code")), allowMissingColumns=True)
    return whole.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("example_id"), "conv_id", "messages", "error_code")


def _in_blocks(turns: DataFrame) -> tuple[DataFrame, Window]:
    """Turns with their ``block`` of a conversation, and the order inside one."""
    blocked = turns.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    return blocked, Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")


def turn_orders(turns: DataFrame) -> DataFrame:
    """``conv_id, error_code``: the turn-order rule on conversations of any length.

    Places come from the order inside a block of turns and the number of turns in
    earlier blocks, so that a long conversation spreads over tasks.
    """
    blocked, inside = _in_blocks(turns.select("conv_id", "turn", "role", "text"))
    placed = blocked.select("conv_id", "block", "role", (F.row_number().over(inside) - 1).alias("i"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("i") == 0, F.col("role"))).alias("first"))
    head = F.first("first").over(Window.partitionBy("conv_id").orderBy("block"))
    starts = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), head.alias("first"))
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block"))
    rows = placed.join(starts, here).select(
        "conv_id", "role", (F.col("i") + F.col("before")).alias("i"),
        F.when(F.col("first") == "system", 1).otherwise(0).alias("skip"))
    expected = F.when(F.pmod(F.col("i") - F.col("skip"), F.lit(2)) == 0, "user").otherwise("assistant")
    fits = F.coalesce(F.when(F.col("i") < F.col("skip"), True).otherwise(F.col("role") == expected), F.lit(False))
    # Pairs to the end: an even number of turns follows the system turn, and at least two.
    rest = F.count(F.lit(1)) - F.max("skip")
    return rows.groupBy("conv_id").agg(
        F.when(~(F.bool_and(fits) & (rest > 0) & (rest % 2 == 0)), "messages.turn_order").alias("error_code"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \n\t\r]+"), F.lit(0))


def word_id(word: Column) -> Column:
    """A stable 28-bit token id."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int")


def conversation_traces(conversations: DataFrame, pad_to: int = 8) -> DataFrame:
    """Word-level traces of assembled conversations (``schemas.TRACES``)."""
    tokens = F.transform("messages", lambda m: F.transform(words(m["content"]), word_id))
    rows = conversations.select(
        "example_id",
        F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
        tokens.alias("_words"),
    )
    opening = lambda role: F.when(role == "system", 10).when(role == "user", 20).otherwise(30)
    body = let(F.col("_words"), lambda w: F.flatten(F.transform(
        "messages", lambda m, i: F.concat(F.array(opening(m["role"])), F.get(w, i), F.array(F.lit(12))))))
    rows = rows.withColumn("_body", F.concat(F.array(F.lit(1)), body, F.array(F.lit(2))))
    lengths = F.transform("_words", lambda w: F.size(w))
    segment = lambda kind, index, start, end: F.struct(
        F.lit(kind).alias("kind"), index.cast("int").alias("message_index"),
        start.cast("int").alias("start"), end.cast("int").alias("end"))
    none = F.lit(None)
    # Message i starts after the prefix and i whole (start, content, end) groups.
    spans = let(lengths, lambda n: F.flatten(F.transform(n, lambda size, i: let(
        1 + 2 * i + F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, x: a + x),
        lambda at: F.array(
            segment("message_start", i, at, at + 1),
            segment("message_content", i, at + 1, at + 1 + size),
            segment("message_end", i, at + 1 + size, at + 2 + size),
        )))))
    used = F.size("_body")
    padded = F.ceil(used / pad_to) * pad_to
    return rows.select(
        "example_id", "messages",
        F.struct(
            F.concat(F.col("_body"), F.array_repeat(F.lit(0), (padded - used).cast("int"))).alias("token_ids"),
            F.lit(0).alias("padding_token_id"),
            F.concat(
                F.array(segment("prefix_special", none, F.lit(0), F.lit(1))), spans,
                F.array(segment("suffix_special", none, used - 1, used), segment("padding", none, used, padded)),
            ).alias("segments"),
        ).alias("trace"),
    )


def coded_traces(turns: DataFrame) -> DataFrame:
    """Traces of the conversations that meet the contract, each with its own code."""
    return validate_traces(conversation_traces(assemble_conversations(turns).where(F.col("error_code").isNull())))


def valid_traces(turns: DataFrame) -> DataFrame:
    """Traces that meet the contract, as their conversations do."""
    return coded_traces(turns).where(F.col("error_code").isNull()).drop("error_code")


def reply_pairs(turns: DataFrame, max_length: int = 512) -> DataFrame:
    """User turns that the next existing turn answers as assistant, as boundary cases.

    Turns follow each other inside blocks of a conversation; the last turn of a
    block looks at the first one of the next block there is, so a hot
    conversation spreads over tasks.
    """
    blocked, inside = _in_blocks(turns.select("conv_id", "turn", "role", "text"))
    ahead = blocked.select(
        "*", F.lead(F.struct("role", "text")).over(inside).alias("reply"), F.row_number().over(inside).alias("n"))
    asks = ahead.where((F.col("role") == "user") & F.col("text").isNotNull())
    heads = ahead.where("n = 1").select("conv_id", "block", F.struct("role", F.when(F.col("role") == "assistant", F.col("text")).alias("text")).alias("head"))
    following = heads.select("conv_id", "block", F.lead("head").over(Window.partitionBy("conv_id").orderBy("block")).alias("reply"))
    last = asks.where(F.col("reply").isNull()).drop("reply").join(following.where("reply.role = 'assistant'"), ["conv_id", "block"])
    columns = ["conv_id", "turn", "text", "reply"]
    paired = asks.where("reply.role = 'assistant'").select(*columns).union(last.select(*columns))
    return paired.where(F.col("reply.text").isNotNull()).select(
        "conv_id", "turn",
        F.concat(F.lit("pair-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("case_id"),
        F.col("text").alias("source"), F.col("reply.text").alias("target"), F.lit(max_length).alias("max_length"),
    )
