import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelscope.llm import repair


def shard(docs, terminals=300, end=0):
    lengths = np.array([len(d) for d in docs])
    ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(d, "<u4") for d in docs]]).astype("<u4")
    return repair.Shard(repair.write_image(list(range(len(docs))), lengths, ids, terminals, end)), ids


def test_round_trip_and_ranges():
    draw = random.Random(1)
    docs = [[draw.choice((1, 2, 3, 299)) for _ in range(draw.randint(0, 400))] + [0] for _ in range(120)] + [[7] * 3000 + [0], [0]]
    read, _ = shard(docs)
    assert len(read.left) > 20 and len(read.symbols) < sum(map(len, docs)) / 2
    for i, d in enumerate(docs):
        assert read.document(i).tolist() == d
        a = draw.randrange(len(d) + 1)
        b = draw.randint(a, len(d))
        assert read.tokens(i, a, b).tolist() == d[a:b]


def test_rules_hold_their_lengths_and_stay_inside_documents():
    read, _ = shard([[1, 2, 0]] * 50)
    for i in range(len(read.left)):  # an end id closes an expansion or is in none
        assert 0 not in read.expand(np.array([300 + i]))[:-1].tolist()
    for i, (a, b) in enumerate(zip(read.left, read.right, strict=True)):
        assert read.spans[300 + i] == read.spans[a] + read.spans[b]


def test_overlapping_pairs_and_large_vocabularies():
    for docs in ([[5] * 101 + [0]], [[5, 6] * 77 + [5, 0]], [[0]] * 9, []):
        read, ids = shard(docs)
        assert np.array_equal(np.concatenate([np.zeros(0, int), *[read.document(i) for i in range(len(docs))]]), ids)
    read, ids = shard([[70_000, 70_001] * 20 + [0]], terminals=100_000)
    assert np.array_equal(read.document(0), ids) and len(read.left) == 0


def test_shards_of_a_table(spark, odd, none, tmp_path):
    library = Tokenizer.from_file(repair.TOKENIZER)
    repair.write_shards(odd, str(tmp_path / "a"), shard_tokens=1000)
    got = repair.read_shards(spark, str(tmp_path / "a")).orderBy("start").collect()
    order = [(r.doc_id, r.text) for r in odd.orderBy(F.col("doc_id").asc_nulls_first(), F.octet_length("text"), "text").collect()]
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert spark.read.parquet(str(tmp_path / "a")).count() >= 2
    repair.write_shards(none, str(tmp_path / "b"))
    assert repair.read_shards(spark, str(tmp_path / "b")).count() == 0
