import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import ctw, lm_scoring as L


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def tokens(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text))] + [ctw.END]


def bits_of(token):
    """``(context, bits before, bit)`` of every decision of a token."""
    stream = token if token == ctw.END else token + b" "
    past = b"\0" * 6 + b" "
    for byte in stream:
        context, name = past[-7:][::-1], 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield context, name, bit
            name = name << 1 | bit
        past += bytes([byte])


class Tree:
    """Weighting by definition: a recursion over counts, the next bit as a ratio of weighted probabilities."""

    def __init__(self, words):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for word, c in words.items():
            for context, name, bit in bits_of(word):
                for d in range(8):
                    self.counts[name, context[:d]][bit] += c
                    if d:
                        self.children[name, context[:d - 1]].add(context[:d])

    def weighted(self, name, context, path=None, bit=None):
        n = list(self.counts.get((name, context), (0, 0)))
        if path is not None:
            n[bit] += 1
        own = math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
        if len(context) == 7:
            return own
        below = set(self.children.get((name, context), ()))
        step = None if path is None else path[:len(context) + 1]
        if step is not None:
            below.add(step)
        under = sum(self.weighted(name, c, path if c == step else None, bit) for c in below)
        return float(np.logaddexp(own, under)) - math.log(2)

    def score(self, word):
        return sum((self.weighted(name, b"", context, bit) - self.weighted(name, b"")) / math.log(10) for context, name, bit in bits_of(word))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    """What every document gets, by doc_id and text."""
    c = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    total, known = sum(c.values()), len(c)
    tree = Tree(c)
    scores = {t: tree.score(t) for t in {t for _, text in rows for t in tokens(text)}}
    return [(d, held(d), len(ts), sum(t in c for t in ts), total, sum(math.log10((c[t] + 1) / (total + known + 1)) for t in ts), sum(scores[t] for t in ts))
            for d, text in rows for ts in [tokens(text)]]


def compare(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-7)


def random_rows(count, seed):
    draw = random.Random(seed)
    return [(i, draw.choice([" ", "\n", "\t"]).join("".join(draw.choice(["the", "re", "Al", "x", "é", "日", "ing", "\x00"]) for _ in range(draw.randint(1, 4)))
                                                    for _ in range(draw.randint(0, 12)))) for i in range(count)]


def short(text):
    return len(text or "") < 10_000


def query(docs):
    return L.score_documents(docs, L.fold_of(F.col("doc_id"), 7) == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")


def test_scores_equal_weighting_by_definition(spark, monkeypatch):
    rows = random_rows(12, 1) + [(None, "the the x"), (None, "the the x"), (70, None), (71, ""), (72, " \n "), (4, "A a"), (73, "q" * 300)]
    monkeypatch.setattr(L, "SHARE_BYTES", 900)
    frame = query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = frame.collect()
    compare(got, rows)
    for r in got:
        assert r.code_length > 0


def test_blocks_lots_and_chunks_of_any_size(spark, monkeypatch):
    rows = random_rows(5, 2) + [(90, "the cat " * 20)]
    for name, value in (("BLOCK_TOKENS", 15), ("CHUNK", 30), ("LOT_WORDS", 9), ("SHARE_BYTES", 100)):
        monkeypatch.setattr(L, name, value)
    parts = list(L.chunks(b"aa bb  cc" * 20))
    assert b" ".join(parts).split() == (b"aa bb  cc" * 20).split()
    compare(query(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect(), rows)


def test_grams_and_sums():
    words = [b"ab", ctw.END, b"x" * 9]
    keys, sizes = ctw.grams(words)
    assert sizes.tolist() == [3, 1, 10]
    want = []
    for word in words:
        past = b"\0" * 6 + b" "
        for byte in word if word == ctw.END else word + b" ":
            want.append(int.from_bytes(past[-7:][::-1] + bytes([byte]), "big"))
            past += bytes([byte])
    assert keys.tolist() == want
    own, n = ctw.merged(np.array([5, 3, 5], np.uint64), np.array([1, 2, 3]))
    assert own.tolist() == [3, 5] and n.tolist() == [2, 4]
    assert L.release_sorted(L.squeeze_sorted(np.sort(keys))).tolist() == sorted(want)
    x = np.array([0.5, 1, 1.5, 7.5, 8, 30.5, 1e6 + 0.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_probabilities_of_next_bytes_sum_to_one():
    words = Counter({b"the": 5, b"then": 2, b"cat": 1})
    tree = Tree(words)
    ways = [bytes([i]) for i in range(256)]
    total = 0.0
    for w in ways:  # the first byte of a word
        total += 10 ** sum((tree.weighted(n, b"", c, b) - tree.weighted(n, b"")) / math.log(10) for c, n, b in list(bits_of(w))[:8])
    assert total == pytest.approx(1.0, rel=1e-9)


def test_no_training_texts(spark):
    rows = [(d, "a b") for d in range(200) if held(d)]
    compare(query(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_odd_rows_and_no_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if short(r.text)]
    got = query(odd.where("text is null or length(text) < 10000")).collect()
    compare(got, rows)
    assert query(odd).count() == odd.count()
    assert query(none).count() == 0


def across(text):
    """``(context, bits before, bit)`` of every decision of a text, whose contexts do not stop at words."""
    past = b"\0" * 6 + b" "
    for byte in b"".join(t if t == ctw.END else t + b" " for t in tokens(text)):
        context, name = past[-7:][::-1], 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield context, name, bit
            name = name << 1 | bit
        past += bytes([byte])


@pytest.mark.parametrize("small", [False, True])
def test_contexts_run_across_words(spark, monkeypatch, small):
    rows = random_rows(5, 3) + [(None, "the cat the cat"), (None, "the cat the cat"), (90, "the cat " * 12), (71, ""), (72, None), (73, " q " * 9)]
    for name, value in (("BLOCK_TOKENS", 5), ("CHUNK", 12), ("LOT_WORDS", 4), ("SHARE_BYTES", 100)) if small else ():
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(ctw, "PIECE", 20)
    tree = Tree({})
    for d, text in rows:
        for context, name, bit in () if held(d) else across(text):
            for n in range(8):
                tree.counts[name, context[:n]][bit] += 1
                if n:
                    tree.children[name, context[:n - 1]].add(context[:n])
    want = sorted(sum((tree.weighted(n, b"", c, b) - tree.weighted(n, b"")) / math.log(10) for c, n, b in across(text)) for _, text in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(r.score for r in L.score_documents(frame, L.fold_of(F.col("doc_id"), 7) == 2, across=True).collect())
    assert got == pytest.approx(want, rel=1e-7)


def test_trees_are_worked_out_some_contexts_at_a_time(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 3)
    keys = np.sort(ctw.distinct(ctw.grams([b"abcd", b"abce", b"xyz", b"the"] * 3)[0])[0])
    parts = ctw.pieces(keys)
    assert len(parts) > 2 and np.concatenate([keys[p] for p in parts]).tolist() == keys.tolist()
    context = keys >> np.uint64(64 - 8 * ctw.TOP)
    assert all(context[p.stop - 1] != context[p.stop] for p in parts[:-1])
    whole, one = ctw.Subtree(keys, np.ones(len(keys))).top(), [ctw.Subtree(keys[p], np.ones(len(keys[p]))).top() for p in parts]
    rows = lambda tops: sorted(zip(*(np.concatenate([t[c] for t in tops]).tolist() for c in tops[0]), strict=True))
    assert rows([whole]) == rows(one)
    assert ctw.pieces(keys[:0]) == []


def test_blocks_hold_words_by_share_and_not_by_row(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w1 W2 \x00é")], "doc_id long, text string").coalesce(1)
    L.write_blocks(docs, str(tmp_path / "blocks"), F.col("doc_id") == 2, True, 4)
    blocks = spark.read.schema(L.BLOCKS).parquet(str(tmp_path / "blocks"))
    assert blocks.count() <= 1 + 2 * 4
    counts = L.word_counts(blocks)
    assert counts.count() <= 4
    row = counts.agg(F.sum("known"), F.sum("total")).first()
    assert tuple(row) == (3001, 3001)


def test_estimates_of_small_and_large_counts():
    n0, n1 = np.array([0, 1, 0, 4094, 4095, 4096, 9e6]), np.array([0, 0, 2, 1, 4096, 0, 7e8])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n0, n1, strict=True)]
    assert np.allclose(ctw.log_estimate(n0, n1), want, rtol=1e-12, atol=1e-9)
    weighted, weight = ctw.weigh(n0, n1, np.array(want) + [0, 5, -5, 800, -800, 1, 0])
    assert np.allclose(weight, 1 / (1 + np.exp(np.array([0, 5, -5, 700, -800, 1, 0]))), rtol=1e-6, atol=1e-300)
    assert np.allclose(weighted, np.logaddexp(want, np.array(want) + [0, 5, -5, 800, -800, 1, 0]) - math.log(2))


def test_grams_of_a_share_pack_well_among_many():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 107, rng.integers(1, 9)).astype(np.uint8)) for _ in range(20_000)]
    keys = ctw.distinct(ctw.grams(words)[0])[0]
    size = lambda share: sum(len(L.squeeze_sorted(keys[at])) for _, at in L.dealt(share))
    near = L.gram_share(keys, 20)
    assert size(near) < 0.9 * size(L.share_of(keys, 20))
    assert sorted(i for _, at in L.dealt(near) for i in at.tolist()) == list(range(len(keys)))
    assert np.bincount(near, minlength=20).max() < 2 * len(keys) / 20


def test_sorted_grams_travel_in_less_than_their_differences_and_come_back():
    words = random.Random(5).choices([b"the", b"cat", b"sat", b"on", b"a", b"mat", b"with", b"others", b"\x00", b"\xff\xfe"], k=20_000)
    text = b" ".join(words) + ctw.END
    grams = ctw.distinct(ctw.text_grams(ctw.PAST + text, np.array([len(text)])))[0]
    odd = [np.array(x, np.uint64) for x in ([], [0], [0, 1, 5, 255, 256, 2**63, 2**64 - 1], [7, 7, 3, 3 << 40])]
    for keys in (grams, *odd):
        back = L.release_sorted(L.squeeze_sorted(keys))
        assert back.dtype == np.uint64 and back.tolist() == keys.tolist()
    assert len(L.squeeze_sorted(grams)) < 0.85 * len(L.squeeze(np.diff(grams, prepend=np.uint64(0))))


def test_grams_are_those_of_each_byte_and_places_are_found_however_keys_cluster():
    data, sizes = b"".join(ctw.PAST + t for t in (b"ab ab\n", b"", b"\x00\xffx\n")), np.array([6, 0, 4])
    streams = [ctw.PAST + t for t in (b"ab ab\n", b"", b"\x00\xffx\n")]
    want = [int.from_bytes(s[i - 7:i][::-1] + s[i:i + 1], "big") for s in streams for i in range(7, len(s))]
    assert ctw.text_grams(data, sizes).tolist() == want
    assert len(ctw.text_grams(b"", np.zeros(0, np.int64))) == 0
    for spread in (np.arange(1000, dtype=np.uint64), np.arange(1000, dtype=np.uint64) << np.uint64(54), np.array([2**64 - 1], np.uint64)):
        keys = np.concatenate([spread[::-1], spread])
        assert spread[L.places(spread, *L.openings(spread), keys)].tolist() == keys.tolist()
