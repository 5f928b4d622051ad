"""Forms of the audits for inputs that no single task holds, against the plain ones."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscope import schemas as S
from labelscope.operators import batched, digests, reconcile, tokens


# --- token grain ------------------------------------------------------------------


def random_example(draw, name):
    """Tokens, segments and roles, with empty segments, gaps and long runs."""
    rows, segments, roles, at = [], [], [], 0
    for i in range(draw.randint(1, 12)):
        role = draw.choice(["system", "user", "assistant"])
        roles.append((name, i, role))
        for kind, size in (("message_start", draw.randint(0, 2)), ("message_content", draw.choice([0, 1, 5, 40])), ("message_end", draw.randint(0, 2))):
            segments.append((name, kind, i, at, at + size))
            at += size
        at += draw.choice([0, 0, 0, 3])  # positions that no segment holds
    segments.append((name, "padding", None, at, at + 4))
    rows = [(name, p, 100 + p) for p in range(at + 4)]
    return rows, segments, roles


def expected(rows, segments, roles):
    roles = {(e, i): r for e, i, r in roles}
    out = {}
    for e, pos, _ in rows:
        held = [s for s in segments if s[0] == e and s[3] <= pos < s[4]]
        kind, index = (held[0][1], held[0][2]) if held else (None, None)
        out[e, pos] = None if kind is None else roles[e, index] if kind == "message_content" else "padding" if kind == "padding" else "boundary"
    return out


def islands(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("block", [1, 7])
def test_token_rows_give_the_categories_and_runs_of_whole_traces(spark, block):
    draw = random.Random(block)
    made = [random_example(draw, f"e{i}") for i in range(8)]
    rows, segments, roles = ([x for m in made for x in m[k]] for k in range(3))
    frames = (spark.createDataFrame(rows, "example_id string, pos long, token_id int"),
              spark.createDataFrame(segments, "example_id string, kind string, message_index int, start int, end int"),
              spark.createDataFrame(roles, "example_id string, message_index int, role string"))
    found = tokens.categories(*frames, block)
    want = expected(rows, segments, roles)
    assert {(r.example_id, r.pos): r.category for r in found.collect()} == want
    for policy, good in ((S.ALL_TOKENS, lambda c: c not in (None, "padding")), ("assistant_only", lambda c: c == "assistant")):
        got = tokens.supervised_runs(tokens.policy_labels(found, policy), block=block).collect()
        runs = [(e, *r) for e in {k[0] for k in want} for r in islands(p for (x, p), c in want.items() if x == e and good(c))]
        assert Counter((r.example_id, r.start, r.end) for r in got) == Counter(runs)


def test_a_long_example_spreads_over_tasks(spark):
    n = 3_000_000
    labels = spark.range(n).select(F.lit("long").alias("example_id"), F.col("id").alias("pos"), F.when(F.col("id") % 1_000_000 == 0, -100).otherwise(1).alias("label"))
    runs = tokens.supervised_runs(labels).orderBy("start").collect()
    assert [(r.start, r.end) for r in runs] == [(1, 1_000_000), (1_000_001, 2_000_000), (2_000_001, n)]
    marked = tokens.categories(
        labels.withColumn("token_id", F.lit(7)).drop("label"),
        spark.createDataFrame([("long", "message_content", 0, 0, n)], "example_id string, kind string, message_index int, start int, end int"),
        spark.createDataFrame([("long", 0, "user")], "example_id string, message_index int, role string"))
    spread = marked.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 3 and max(r["count"] for r in spread) < n // 2


def test_no_tokens(spark):
    labels = spark.createDataFrame([], "example_id string, pos long, label int")
    assert tokens.supervised_runs(labels).count() == 0


# --- batches of a user's function ----------------------------------------------------


#: A lambda, since workers do not see this module.
sized = lambda batch: pd.DataFrame({"id": batch["id"], "rows": len(batch)})


@pytest.mark.parametrize("size", [7, 50_000])
def test_a_function_sees_batches_of_the_size_asked_for(spark, size):
    rows = spark.range(0, 25_000, numPartitions=3)
    got = batched.batched_map(rows, sized, size, "id long, rows long").withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.id for r in got) == list(range(25_000))
    by_partition = Counter(r.p for r in got)
    for p, total in by_partition.items():
        sizes = Counter(r.rows for r in got if r.p == p)
        assert sizes == +Counter({size: total - total % size, total % size: total % size})


def test_batches_in_order_are_short_only_at_the_end(spark):
    rows = spark.range(0, 1003, numPartitions=5).select((1002 - F.col("id")).alias("id"))
    got = batched.ordered_map(rows, ("id",), lambda b: b.assign(rows=len(b), first=b["id"].iloc[0]), 100, "id long, rows long, first long").collect()
    assert all(r.first == r.id // 100 * 100 and r.rows == (3 if r.id >= 1000 else 100) for r in got) and len(got) == 1003


def test_a_function_may_return_other_rows(spark):
    double = lambda b: pd.concat([b, b]).assign(text="x")[["text", "id"]]
    assert batched.batched_map(spark.range(5), double, 2, "id long, text string").count() == 10
    assert batched.batched_map(spark.range(5), lambda b: b.iloc[:0], 2, "id long").count() == 0
    assert batched.batched_map(spark.range(0), sized, 2, "id long, rows long").count() == 0
    with pytest.raises(Exception, match="returned no column rows"):
        batched.batched_map(spark.range(5), lambda b: b, 2, "id long, rows long").collect()
    with pytest.raises(ValueError):
        batched.batched_map(spark.range(5), sized, 0, "id long, rows long")


# --- stored inventories ---------------------------------------------------------------


def test_stored_drift_equals_the_full_join_and_reads_unequal_buckets(spark, tmp_path):
    rows = [(f"n{i}", None if i % 50 == 0 else f"h{i}") for i in range(3000)]
    changed = [(n, "other" if n in ("n5", "n50") else None if n == "n6" else h) for n, h in rows if n not in ("n7", "n8")] + [("new", None)]
    frames = [spark.createDataFrame(x, "name string, sha256 string") for x in (changed, rows)]
    paths = [str(tmp_path / x) for x in ("actual", "expected")]
    for frame, path in zip(frames, paths, strict=True):
        digests.store_inventory(frame, path, 8, 16)
    drift = digests.stored_drift(spark, *paths)
    assert Counter(map(tuple, drift.collect())) == Counter(map(tuple, reconcile.golden_drift(*frames).collect()))
    buckets = digests.unequal_buckets(spark, *paths)
    assert 0 < len(buckets) <= 6
    plan = drift._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and plan.count("bucket#") > 2 and "PartitionFilters: []" not in plan
    assert digests.unequal_buckets(spark, paths[1], paths[1]) == []
    assert digests.stored_drift(spark, paths[1], paths[1]).count() == 0


def test_digests_do_not_depend_on_order_and_see_nulls(spark):
    frame = lambda rows: spark.createDataFrame([(n, h, 0) for n, h in rows], "name string, sha256 string, b int")
    digest = lambda rows: tuple(digests.bucket_digests(frame(rows), "b").first())
    rows = [("a", "1"), ("b", None), ("c", "3")]
    assert digest(rows) == digest(rows[::-1])
    assert len({digest(x) for x in (rows, rows[:2], [("a", "1"), ("b", ""), ("c", "3")], [("a", "3"), ("b", None), ("c", "1")], [*rows, rows[0], rows[0]])}) == 5
