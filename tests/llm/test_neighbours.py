import numpy as np
from pyspark.sql import functions as F

from labelscope.llm import neighbours


def exact(ids, vectors, queries, top):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))
        out[q] = [ids[i] for i in order[:top]]
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v], "clash") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, cell string")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_all_cells_give_the_exact_answer(spark):
    draw = np.random.default_rng(1)
    vectors = draw.integers(-3, 4, (300, 7)).astype(float)  # many ties
    vectors[50:90] = vectors[50]  # and one common vector
    vectors[~vectors.any(axis=1)] = 1
    ids = list(range(300))
    got = neighbours.search(frame(spark, ids, vectors), F.col("vec_id") % 5 == 0, top=20, codewords=8, share=1.0)
    assert found(got) == exact(ids, vectors, range(0, 300, 5), 20)
    row = got.where("query_id = 10 and rank = 1").first()
    assert row.score == vectors[10] @ vectors[row.vec_id]


def test_walk_goes_by_summed_distance():
    draw = np.random.default_rng(2)
    first, second = draw.random(9), draw.random(9)
    counts = draw.integers(0, 3, 81)
    cells = neighbours.walk(first, second, counts, 10**9)
    total = [first[c // 9] + second[c % 9] for c in cells]
    assert total == sorted(total) and set(cells) == set(np.flatnonzero(counts).tolist())
    some = neighbours.walk(first, second, counts, 20)
    assert cells[:len(some)] == some and counts[some].sum() >= 20 > counts[some[:-1]].sum()


def test_split_groups_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 16)
    vectors = np.random.default_rng(3).normal(size=(200, 6))
    vectors[:120] = vectors[0] + vectors[:120] * 1e-3  # one crowded cell
    vectors = vectors.astype(np.float32).astype(float)
    got = neighbours.search(frame(spark, list(range(200)), vectors), F.col("vec_id") % 20 == 0, codewords=4, share=1.0)
    assert found(got) == exact(list(range(200)), vectors, range(0, 200, 20), 20)


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.toPandas()
    ids, x = rows.vec_id.tolist(), np.array(rows.embedding.tolist(), float)
    got = found(neighbours.search(vectors, F.col("vec_id") % 20 == 0))
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 1.0, 1.0]), (7, []), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (8, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(neighbours.search(df, F.col("vec_id") % 20 == 0)) == {0: [20, 8], 20: [0, 8]}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
