"""Every source against every target, without forming the pairs.

Where a source meets a target only the last characters of the one and the first
of the other can merge, compose or be stripped. Far from the seam tokens are what
they are in the text alone, and a report's classes see only how many there are.

So each side is cut at the place nearest the seam that nothing reaches across, and
grouped by what is left and by the number of tokens cut off. Each tail is audited
with each head once, as a case of a few characters; its run ends are moved by the
tokens cut off, and the counts of both groups multiplied. Counts of target tokens
stand in running sums, so that a length decides over a range of them at once.

What there is to do grows with the sides' texts (once through each) and with the
distinct tails, heads and lengths, never with the number of pairs. A text without
such a place is its own tail or head.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import text as txt
from labelscope.functions import unicode as uni
from labelscope.functions.arrays import let
from labelscope.functions.bpe import BpeTokenizer
from labelscope.operators import boundary

#: Characters near the seam among which a place to cut is looked for.
WINDOW = 64
#: Tasks over which pairs of tails and heads are dealt.
BLOCKS = 32


def _inner_pairs(tokenizer: BpeTokenizer) -> list[str]:
    """Characters that stand side by side in some merged piece."""
    return sorted({(a + b)[k:k + 2] for a, b in tokenizer.merges for k in range(len(a + b) - 1)})


def _cuts(window: Column, inner: list[str]) -> Column:
    """Places ``i`` before which nothing reaches across: between characters that no
    piece holds side by side, before an ASCII character, which never composes with
    what is before it."""
    chars = F.split(window, "")
    pairs = let(chars, lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    apart = lambda p: ~F.concat(p["x"], p["y"]).isin(*inner) if inner else F.lit(True)
    safe = lambda p: p["y"].isNotNull() & (F.octet_length(p["y"]) == 1) & apart(p)
    return F.filter(F.transform(pairs, lambda p, i: F.when(safe(p), F.struct(
        (i + 1).alias("at"), ((txt.right_strip(p["x"]) != "") & (txt.right_strip(p["y"]) != "")).alias("shown")))), lambda x: x.isNotNull())


def _same(texts: pd.Series) -> pd.Series:
    def same(text: str | None) -> bool:
        whole, *_, complete, ambiguous = uni._replay_one(text)
        return text is None or (whole == text and bool(complete) and not ambiguous)

    return texts.map(same).astype(bool)


def _settled(rows: DataFrame, name: str, tokenizer: BpeTokenizer, ends: bool) -> DataFrame:
    """Adds whether the text ``name`` is what its tokens spell, origins and all, and their
    number; ``ends``: white space at its end is the text's end, and goes."""
    text = F.col(name)
    stripped = txt.right_strip(text)
    pieces = tokenizer.pieces(stripped if ends else text)
    known = ~F.array_contains(tokenizer.ids(pieces), F.lit(tokenizer.unknown_id).cast("bigint"))
    # Not to be moved into an aggregate's keys, where Python functions cannot stand.
    same = F.pandas_udf(_same, "boolean").asNondeterministic()(F.when(uni.may_change(text), text))
    return rows.withColumns({
        "_clean": F.coalesce(same & (txt.encoder_strip(text) == stripped) & known, F.lit(False)), "_tokens": F.size(pieces)})


def source_parts(sources: DataFrame, tokenizer: BpeTokenizer, most: int) -> DataFrame:
    """``source, tail, cut_off``: a source's last characters and the number of tokens before them (``most`` and more are one)."""
    inner = _inner_pairs(tokenizer)
    stripped = txt.right_strip(F.col("source"))
    rows = sources.select("source", F.char_length(stripped).alias("_n"), stripped.alias("_s"))
    start = F.greatest(F.lit(0), F.col("_n") - WINDOW)
    places = _cuts(F.substring(F.col("_s"), start + 1, F.lit(WINDOW)), inner)
    rows = rows.withColumn("_at", F.coalesce(start + F.get(F.reverse(places), F.lit(0))["at"], F.lit(0)))
    rows = _settled(rows.withColumn("_front", F.substring(F.col("source"), F.lit(1), F.col("_at"))), "_front", tokenizer, ends=False)
    cut = F.when(F.col("_clean"), F.col("_at")).otherwise(0)
    return rows.select(
        "source", F.substring(F.col("source"), cut + 1, F.char_length("source")).alias("tail"),
        F.when(cut > 0, F.least(F.lit(most), F.col("_tokens"))).otherwise(0).alias("cut_off"))


def source_tails(sources: DataFrame, tokenizer: BpeTokenizer, most: int) -> DataFrame:
    """``tail, cut_off, sources``: numbers of sources."""
    return source_parts(sources, tokenizer, most).groupBy("tail", "cut_off").agg(F.count(F.lit(1)).alias("sources"))


def target_parts(targets: DataFrame, tokenizer: BpeTokenizer, most: int) -> DataFrame:
    """``target, head, follows, cut_off``: a target's first characters, the first of what
    was cut off (or none), and the number of its tokens."""
    inner = _inner_pairs(tokenizer)
    rows = targets.select("target", F.char_length(txt.right_strip(F.col("target"))).alias("_n"))
    places = _cuts(F.substring(F.col("target"), F.lit(1), F.lit(WINDOW)), inner)
    # Neither the head's last character nor the one that follows is white space, which may be stripped.
    good = let(F.col("_n"), lambda n: F.filter(places, lambda p: p["shown"] & (p["at"] < n)))
    rows = rows.withColumn("_at", F.get(good, F.lit(0))["at"])
    rest = F.substring(F.col("target"), F.coalesce("_at", F.lit(0)) + 1, F.char_length("target"))
    rows = _settled(rows.withColumn("_rest", rest), "_rest", tokenizer, ends=True)
    at = F.when(F.col("_clean"), F.col("_at"))
    return rows.select(
        "target", F.when(at.isNull(), F.col("target")).otherwise(F.substring(F.col("target"), F.lit(1), at)).alias("head"),
        F.when(at.isNull(), F.lit("")).otherwise(F.substring(F.col("target"), at + 1, F.lit(1))).alias("follows"),
        F.when(at.isNull(), F.lit(0)).otherwise(F.least(F.lit(most), F.col("_tokens"))).alias("cut_off"))


def target_heads(targets: DataFrame, tokenizer: BpeTokenizer, most: int) -> DataFrame:
    """``head, follows, sums``: how many targets have up to 0, 1, ... ``most`` tokens after their head."""
    grouped = target_parts(targets, tokenizer, most).groupBy("head", "follows", F.col("cut_off").alias("_b")).agg(F.count(F.lit(1)).alias("_k"))
    # At most ``most`` + 1 numbers a head.
    heads = grouped.groupBy("head", "follows").agg(F.collect_list("_b").alias("_b"), F.collect_list("_k").alias("_k"))
    return heads.select("head", "follows", _running(most)("_b", "_k").alias("sums"))


def _running(most: int):
    def run(numbers: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([np.cumsum(np.bincount(b, k, most + 1)).astype(np.int64) for b, k in zip(numbers, counts, strict=True)], dtype=object)

    run.__annotations__ = {"numbers": pd.Series, "counts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<bigint>")


def seam_cases(tails: DataFrame, heads: DataFrame, tokenizer: BpeTokenizer) -> DataFrame:
    """Attributed cases of every tail with every head.

    Both are tables of a few characters; their pairs are dealt over ``BLOCKS``.
    """
    left = tails.select("tail").distinct().withColumn("_block", F.pmod(F.xxhash64("tail"), F.lit(BLOCKS)))
    right = heads.select("head", "follows").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCKS - 1).cast("bigint"))))
    pairs = left.join(right, "_block").select(
        "tail", "head", "follows", F.lit("seam").alias("case_id"), F.col("tail").alias("source"), F.concat("head", "follows").alias("target"))
    keep = ("source_raw", "token_count", "source_end", "cross_end", "target_end", "source_walk", "full_walk", "source_norm_reasons", "combined_norm_reasons",
            "source_encoder_text", "source_normalized", "combined_encoder_text", "combined_normalized", "source_complete", "combined_complete")
    return boundary.attributed_cases(pairs, tokenizer).select("tail", "head", "follows", F.size("source_raw").alias("_own"), *keep[1:])


def _moved(walk: str, text: str, by: Column) -> Column:
    """A walk whose tokens stand ``by`` places later."""
    usable = F.col(f"{text}_complete") & boundary.runtime_matches(text)
    w = F.col(walk)
    for f in ("first_unknown", "first_unaligned", "first_bad_offset"):
        w = w.withField(f, F.col(f"{walk}.{f}") + by)
    return w.withField("first_untraced", F.when(~usable & (by > 0), F.lit(1)).otherwise(F.col(f"{walk}.first_untraced")))


def matrix_cells(sources: DataFrame, targets: DataFrame, tokenizer: BpeTokenizer, lengths: tuple[int, ...]) -> DataFrame:
    """Groups of cells (source, target, length) with their number ``_cells`` and classes."""
    most = max(lengths) + 4
    tails, heads = source_tails(sources, tokenizer, most), target_heads(targets, tokenizer, most)
    seams = seam_cases(tails, heads, tokenizer)
    rows = seams.join(tails, "tail").join(heads, ["head", "follows"]).withColumn("max_length", F.explode(F.array(*map(F.lit, lengths))))
    a, n, own = F.col("cut_off"), F.col("token_count"), F.col("_own") + F.col("cut_off") + 1
    one = (F.col("follows") != "").cast("int")  # the one token that stands for those cut off
    # Numbers of cut-off target tokens at which something may change: where the whole
    # passes the length, the source's cutoff, or the end of the source's tokens.
    marks = F.array(F.lit(0), F.lit(1), *[x - (n - one) - a + d for x in (F.col("max_length"), own, F.col("cross_end") + a) for d in (-1, 0, 1, 2)])
    starts = F.array_sort(F.array_distinct(F.filter(marks, lambda b: b.between(0, most))))
    last = F.size("sums") - 1
    ranges = let(F.struct(starts.alias("b"), F.col("sums").alias("s"), last.alias("last")), lambda x: F.transform(x["b"], lambda b, i: F.struct(
        b.alias("low"), (F.get(x["s"], F.coalesce(F.get(x["b"], i + 1) - 1, x["last"])) - F.coalesce(F.get(x["s"], b - 1), F.lit(0))).alias("targets"))))
    rows = rows.withColumn("_range", F.explode(F.filter(ranges, lambda r: r["targets"] > 0)))
    b = F.col("_range.low") - one
    usable = F.col("combined_complete") & boundary.runtime_matches("combined")
    at = lambda name: F.when(usable, F.col(name) + a).otherwise(F.col(name))
    whole = F.col("target_end") == n
    rows = rows.select(
        "tail", a.alias("_a"), "head", "follows", F.col("_range.low").alias("_low"),
        "max_length", (F.col("sources") * F.col("_range.targets")).alias("_cells"), own.alias("_own"), (n + a + b).alias("token_count"),
        at("source_end").alias("source_end"), at("cross_end").alias("cross_end"),
        (at("target_end") + F.when(whole & usable, b).otherwise(0)).alias("target_end"),
        _moved("source_walk", "source", a).alias("source_walk"), _moved("full_walk", "combined", a).alias("full_walk"),
        *(c for c in rows.columns if c.endswith(("_norm_reasons", "_encoder_text", "_normalized"))))
    return boundary.add_classes(boundary.with_limits(rows, F.col("_own")))


def matrix_counts(sources: DataFrame, targets: DataFrame, tokenizer: BpeTokenizer, lengths: tuple[int, ...]) -> DataFrame:
    """``classifications, cases``: cells of (source, target, length) by classes, over all rows of both sides.

    ``sources`` has ``source``, ``targets`` has ``target``; equal rows count each.
    """
    return matrix_cells(sources, targets, tokenizer, lengths).groupBy(F.array_join("classifications", "|").alias("classifications")).agg(F.sum("_cells").alias("cases"))
