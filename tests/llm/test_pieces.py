import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from labelscope.llm import pieces

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ALPHABET = [" ", "  ", "   ", "\n", "a", "e", "th", "the", "▁", "é", "é", "ﬁ", "日", "梦", "x", "<s>", ".", "!", "ing", "\t", "\x00",
            "1", "22", "😀", "'s", " ", "%%%", "aaaa"]


def expected(text):
    return LIB.encode(text, add_bos=True, add_eos=True)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.PieceModel.load(pieces.MODEL))


def test_ids_equal_the_library_on_random_texts(encoder):
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == expected(text), repr(text)


def test_long_runs(encoder):
    for text in (" " * 1003 + "a", "b" * 50_000, "ab" * 20_000 + " " * 33, "\n" * 500, "日" * 999):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == expected(text)


def test_backtracking_where_the_longest_piece_is_wrong():
    # Merging gives ab before bc, so "abc" starts with its longest piece only if that piece is reachable.
    names = ["a", "b", "c", "d", "bc", "ab", "abc", "cd"]
    model = pieces.PieceModel(names, list(range(len(names))), [0.0, 0.0, 0.0, 0.0, -1.0, -2.0, -3.0, -4.0], [0] * 256, 90, 91)
    for text in ("abc", "abcd", "bcd", "abab", "dcba", "abcbcd", "aabbccdd"):
        assert [names[i] for i in model.encode_part(text)] == model.merged(text)


def test_bounded_tables_change_nothing(encoder):
    small = pieces.Encoder(encoder.model, limit=3)
    text = "the cat sat on the mat, the cats sat on mats"
    assert small.ids(text) == encoder.ids(text) and len(small.known) > 3  # a text's own parts stay


def test_digests(spark, odd, none):
    got = {(r.doc_id, r.t): r for r in odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), pieces.digests_column(F.col("text")).alias("d")).select("doc_id", "t", "d.*").collect()}
    assert len(got) == 11  # the repeated row
    for (_, text), r in got.items():
        ids = expected(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert none.select(pieces.digests_column(F.col("text")).alias("d")).count() == 0
