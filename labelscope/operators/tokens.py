"""The topology audit one token a row, for examples longer than a task can hold.

``tokens`` rows are ``example_id, pos, label``; ``segments`` rows ``example_id, kind,
message_index, start, end``; ``roles`` rows ``example_id, message_index, role``. An
example is cut into blocks of positions. Segments are laid into the blocks they
reach; inside a block each token takes the segment that opened last, and runs of
supervised tokens are found. What crosses a border is settled between the few runs
that touch one, so a long example spreads over tasks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope import schemas as S

#: Positions of a block.
BLOCK = 1 << 16


def trace_rows(traces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tokens with token_id, segments, roles)`` of a table of whole traces."""
    tokens = traces.select("example_id", F.posexplode("trace.token_ids").alias("pos", "token_id"))
    segments = traces.select("example_id", F.explode("trace.segments").alias("s")).select("example_id", "s.*")
    roles = traces.select("example_id", F.posexplode("messages").alias("message_index", "m")).select("example_id", "message_index", "m.role")
    return tokens.withColumn("pos", F.col("pos").cast("long")), segments, roles


def _laid(segments: DataFrame, block: int) -> DataFrame:
    """A row for each block that a segment reaches, from its first position there. Empty segments hold no token."""
    reached = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    held = segments.where(F.col("end") > F.col("start")).withColumn("block", F.explode(reached))
    return held.withColumn("pos", F.greatest(F.col("start").cast("long"), F.col("block") * block))


def categories(tokens: DataFrame, segments: DataFrame, roles: DataFrame, block: int = BLOCK) -> DataFrame:
    """``tokens`` with the ``category`` of each: its message's role, ``boundary`` or ``padding``.

    NULL where no segment holds the position.
    """
    named = segments.join(roles.withColumnRenamed("example_id", "_of").withColumnRenamed("message_index", "_at"),
                          (F.col("example_id") == F.col("_of")) & (F.col("message_index") == F.col("_at")) & (F.col("kind") == "message_content"), "left")
    category = F.when(F.col("kind") == "message_content", F.col("role")).when(F.col("kind") == "padding", "padding").otherwise("boundary")
    opened = _laid(named.withColumn("_category", category), block).select(
        "example_id", "block", "pos", F.struct("_category", F.col("end").cast("long").alias("end")).alias("_segment"), F.lit(0).alias("_kind"))
    rows = tokens.select("example_id", F.floor(F.col("pos") / block).alias("block"), "pos", F.struct(
        *[c for c in tokens.columns if c not in ("example_id", "pos")], F.lit(True).alias("_token")).alias("_row"), F.lit(1).alias("_kind"))
    both = opened.unionByName(rows, allowMissingColumns=True)
    # Segments do not overlap, so the last that opened is the only one that can hold a position.
    order = Window.partitionBy("example_id", "block").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_in", F.last("_segment", ignorenulls=True).over(order)).where("_kind = 1")
    return placed.select("example_id", "pos", "_row.*", F.when(F.col("pos") < F.col("_in.end"), F.col("_in._category")).alias("category")).drop("_token")


def policy_labels(categorized: DataFrame, policy: str) -> DataFrame:
    """``label`` of each token: its id where the policy supervises it."""
    eligible = (F.col("category") != "padding") if policy == S.ALL_TOKENS else (F.col("category") == "assistant")
    return categorized.withColumn("label", F.when(F.coalesce(eligible, F.lit(False)), F.col("token_id")).otherwise(S.IGNORE_INDEX))


def supervised_runs(labels: DataFrame, keys: tuple[str, ...] = ("example_id",), block: int = BLOCK) -> DataFrame:
    """``keys, start, end`` of each run of supervised positions (``pos``, ``label``).

    Runs are found inside blocks. Those that touch a border, two a block at most,
    are then joined to each other.
    """
    on = labels.where(F.col("label") != S.IGNORE_INDEX).select(*keys, "pos", F.floor(F.col("pos") / block).alias("_block"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("pos"))
    runs = on.withColumn("_island", F.col("pos") - place).groupBy(*keys, "_block", "_island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_block", "_island")
    at_border = (F.col("start") % block == 0) | (F.col("end") % block == 0)
    inner, outer = runs.where(~at_border), runs.where(at_border)
    order = Window.partitionBy(*keys).orderBy("start")
    opens = F.coalesce((F.lag("end").over(order) != F.col("start")).cast("int"), F.lit(1))
    joined = outer.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order))
    whole = joined.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    return inner.select(*keys, "start", "end").unionByName(whole.select(*keys, "start", "end"))
