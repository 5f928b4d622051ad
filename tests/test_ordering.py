"""Places and batches in the order of a whole table."""

import random

import pytest
from pyspark.sql import functions as F

from labelscope.operators import ordering


def table(spark, rows):
    return spark.createDataFrame(rows, "a long, b string, body string").repartition(7)


def test_places_follow_the_order_on_a_hot_key(spark):
    rows = [(5, f"{i:05d}", "x") for i in range(3000)] + [(None, None, "n")] + [(k, "z", "y") for k in range(5)] + [(None, "b", "m")]
    got = ordering.with_places(table(spark, rows), ("a", "b")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(len(rows)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert [(r.a, r.b, r.body) for r in got] == sorted(rows, key=key)


@pytest.mark.parametrize(("count", "size"), [(0, 3), (1, 3), (9, 3), (10, 3), (1001, 64)])
def test_only_the_last_batch_is_short(spark, count, size):
    rows = [(i % 4, f"{i:05d}", "x") for i in range(count)]
    random.Random(1).shuffle(rows)
    batches = ordering.dataset_batches(table(spark, rows), ("a", "b"), size).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()
    assert [r.n for r in batches] == [size] * (count // size) + ([count % size] if count % size else [])
    assert [r.batch for r in batches] == list(range(len(batches)))


def test_descending_and_computed_order(spark):
    rows = [(i, str(i % 3), "x") for i in range(50)]
    got = ordering.with_places(table(spark, rows), (F.col("b").desc(), F.col("a") % 7, "a")).orderBy("place").collect()
    assert [r.a for r in got] == [r[0] for r in sorted(rows, key=lambda r: (-int(r[1]), r[0] % 7, r[0]))]


def test_sums_over_many_ranges_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FAN", 3)
    keys = [0, 1, 2, 5, 6, 8, 9, 20]
    counts = spark.createDataFrame([(k, k + 1) for k in keys], "k long, n long")
    got = {r.k: r.before for r in ordering.running_before(counts, "k", "n").collect()}
    assert got == {k: sum(j + 1 for j in keys if j < k) for k in keys}


def test_a_batch_needs_a_row(spark):
    with pytest.raises(ValueError):
        ordering.dataset_batches(table(spark, []), ("a", "b"), 0)
