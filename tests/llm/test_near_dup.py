import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import near_dup
from labelscope.llm.components import components
from labelscope.llm.registry import registered

SF = "/root/testdata/sf0.01"


def brute(texts, size):
    """``id: (set size, component)`` from all pairs."""
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_whole_table_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registered()["op3_minhash_near_dup"](spark, SF)
    assert found(got) == brute(texts, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_large_groups_of_near_copies(spark):
    """A third of all rows near copies at the edge of the threshold, and chains, in buckets over a block's size."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(500):
        words = list(base)
        for at in draw.sample(range(60), draw.choice((0, 1, 2, 3, 4))):
            words[at] = f"v{draw.randrange(1000)}"
        texts[i] = " ".join(words)
    texts |= {i: " ".join(f"z{draw.randrange(400)}" for _ in range(draw.randint(1, 40))) for i in range(500, 900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (2, 5):
        assert found(near_dup.near_duplicates(docs, size)) == brute(texts, size)


def test_shingles():
    size = lambda text, k: len(near_dup.shingle_set(text.encode(), k))
    assert [size(t, 2) for t in ("", " \t", "a", "a b", "a b a b", "A b a B")] == [0, 0, 1, 1, 2, 2]
    key = lambda text, k: near_dup.shingle_set(text.encode(), k).tolist()
    assert key("a b", 5) != key("a b", 2) and key("x y", 5) == key("X  Y", 5) != key("y x", 5)


def test_posterior_bounds():
    steps = near_dup.least_matches()
    assert [n for n, _ in steps] == list(range(42, 253, 42)) and all(0 < m < 0.8 * n for n, m in steps)
    # The stated chance: few pairs at the threshold fall below the last bound.
    draw = np.random.default_rng(0)
    assert (draw.binomial(252, 0.8, 200_000) < steps[-1][1]).mean() < 1e-4
    same = np.ones((3, 252), np.uint16)
    other = same.copy()
    other[1, :] = 0
    assert near_dup.plausible(same, other, steps).tolist() == [0, 2]


def test_components_of_paths_and_stars(spark):
    links = [(i + 1, i) for i in range(0, 40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (500, 501), (501, 500)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        got[r.component].add(r.node)
    assert got == {0: set(range(41)), 100: set(range(100, 300)), 500: {500, 501}}


def test_odd_rows(spark, odd, none):
    got = near_dup.near_duplicates(odd, 2).collect()
    one = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and [r.kept for r in got if r.doc_id == 1] == [True, True]
    assert one[2].component_id == 1 and not one[2].kept
    assert [(one[i].n_shingles, one[i].component_id, one[i].kept) for i in (3, 4, 5)] == [(0, i, True) for i in (3, 4, 5)]
    assert one[None].component_id == 7 and not one[None].kept  # as a row with the same set
    assert one[9].n_shingles == 1 and one[6].component_id == 1  # the long text repeats the words of 1
    assert near_dup.near_duplicates(none, 2).count() == 0


def test_stage_keeps_one_of_each_group(spark, odd):
    kept = near_dup.stage_near_dup(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 7, 8, 9, 10]


@pytest.mark.parametrize("size", [2, 5])
def test_bucket_of_a_common_band_is_compared_across(spark, size):
    texts = {i: " ".join(["same"] * 3 + [f"u{i // 2}x{k}" for k in range(30)] + ([f"y{i}"] if i % 2 else [])) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("component", F.lit("clash"))
    assert found(near_dup.near_duplicates(docs, size)) == brute(texts, size)


def test_rows_without_an_id_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda i: " ".join([*base[:-1], f"end{i}"])
    other = lambda i: " ".join(f"o{k}" for k in range(99)) + f" last{i}"
    alone = " ".join(f"u{k}" for k in range(50))
    docs = spark.createDataFrame(
        [(None, near(i)) for i in range(5)] + [(None, near(0))] * 3 + [(None, alone)] * 2
        + [(7, other(0)), (8, other(1)), (8, "a text that no other row has at all")], "doc_id long, text string")
    got = near_dup.near_duplicates(docs, 2).collect()
    assert len(got) == 13 and {r.component_id for r in got if r.doc_id is None} == {None}
    kept = near_dup.stage_near_dup(spark, docs, "").collect()
    texts = [r.text for r in kept]
    # One near copy without an id, one of the exact copies, and of id 8 the unique text only.
    assert sum(t.startswith("w0") for t in texts) == 1 and texts.count(alone) == 1
    assert sorted((r.doc_id, r.text[:2]) for r in kept if r.doc_id) == [(7, "o0"), (8, "a ")]
    # A copy goes, whatever its id's other text does; with an id it stays before rows without one.
    more = docs.union(spark.createDataFrame([(9, near(1)), (7, near(2))], docs.schema))
    rows = near_dup.stage_near_dup(spark, more, "").collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in rows) == [(0, "u0"), (7, "o0"), (7, "w0"), (8, "a ")]


def test_few_links_take_few_partitions(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(0, 10), (10, 21)], "a long, b long")
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("false", "20"), strict=True):
            spark.conf.set(name, value)
        found = components(links)
        assert found.rdd.getNumPartitions() <= 2
        placed = {r.node: r.component for r in found.collect()}
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    assert placed == {n: 0 if n in (0, 1, 10, 11, 20, 21) else n - n % 2 for n in range(40)}
