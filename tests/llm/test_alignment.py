import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelscope.llm import alignment as A

FIRST = Tokenizer.from_file(A.BYTE_LEVEL)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=A.PIECES)
#: Bytes that the byte-level alphabet spells as themselves; the others follow from 256.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


def tokens(text):
    """``(id, bytes)`` of both tokenizers from the libraries themselves, or None."""
    if not text:
        return None
    a = [(i, bytes(BYTES[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(SECOND.id_to_piece(i)[3:5], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode()) for i in SECOND.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def groups(text):
    """Groups of ids by ends that both have, and the links."""
    found = tokens(text)
    if not found:
        return [], []
    ends = []
    for side in found:
        at, where = 0, []
        for i, raw in side:
            at += len(raw)
            where.append((at, i))
        ends.append(where)
    common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    out, at = [], [0, 0]
    for stop in common:
        some = []
        for k, side in enumerate(ends):
            start = at[k]
            while at[k] < len(side) and side[at[k]][0] <= stop:
                at[k] += 1
            some.append([i for _, i in side[start:at[k]]])
        out.append(tuple(some))
    where = dict(ends[0])  # no token is empty, so no two end at one place
    return out, [(where[f], y) for f, y in ends[1] if f in where]


def brute(rows):
    aligned = [(d, t, *groups(t)) for d, t in rows]
    count = Counter(link for *_, links in aligned for link in links)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = Counter()
    for d, _, found, links in aligned:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found)
        out[d, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links),
            sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if found else ""] += 1
    return out, count


ALPHABET = [" ", "  ", "   ", "\n", "\n\n", " \n ", "a", "the", "The", "don't", "'tis", "'s", "x'll", "''", "é", "é", "日本", "б", "aб", "😀", "<|endoftext|>", "<s>",
            "<0x41>", "1", "22", "8abc", "5'8", "'", ".", ",", "$x", "ing", "\t", "\r\n", ";\r", " ", "　", "\x85", "\x00", "ß", "İ", "%%%", "www"]


def random_rows(count, seed, alphabet=ALPHABET):
    draw = random.Random(seed)
    return [(i, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 25)))) for i in range(count)]


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want, _ = brute(rows)
    assert Counter(map(tuple, A.align_documents(docs).collect())) == want


def test_results_equal_brute_force(spark):
    plain = [x for x in ALPHABET if x.isascii() and not set(x) & set("\t\r\x00")]
    check(spark, random_rows(500, 1) + random_rows(500, 2, plain) + [(None, "the cat"), (None, "the cat"), (7, None), (8, ""), (9, "a▁b")])


def test_small_blocks_runs_and_tables(spark, monkeypatch):
    rows = random_rows(120, 3) + [(900, "the cat sat on the mats, " * 50)]
    want, _ = brute(rows)
    monkeypatch.setattr(A, "RUN_UNITS", 7)
    aligner = A.Aligner(limit=20)
    found, first = {}, 0
    for done, docs, pairs in aligner.align([t for _, t in rows]):
        for i, d in enumerate(done):
            found[first + i] = (d, Counter(pairs[docs == i].tolist()))
        first += len(done)
    assert len(found) == len(rows)
    for (_, text), (d, pairs) in zip(rows, found.values(), strict=True):
        some, links = groups(text)
        assert d[:3] == (sum(len(a) for a, _ in some), sum(len(b) for _, b in some), len(some))
        assert pairs == Counter(a << 24 | b for a, b in links)


def test_pair_counts(spark, tmp_path):
    rows = random_rows(300, 4)
    A.write_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "index"))
    got = {(r.a, r.b): (r.pair_docs, r.pair_links) for r in A.pair_counts(spark.read.schema(A.ROWS).parquet(str(tmp_path / "index"))).collect()}
    _, count = brute(rows)
    docs = Counter(link for _, t in rows for link in set(groups(t)[1]))
    assert got == {k: (docs[k], n) for k, n in count.items()}


@pytest.mark.parametrize("size", [1, 100, A.LIST_DOCS - 1, A.LIST_DOCS, 60_000])
def test_planes(size):
    draw = np.random.default_rng(size)
    slots = np.sort(draw.choice(A.BLOCK_DOCS, size, replace=False))
    times = draw.integers(1, 40, size)
    raw = A.pack_planes(slots, times)
    back = A.unpack_planes(raw)
    assert (back[0] == slots).all() and (back[1] == times).all()
    assert A.popcounts(raw) == (size, int(times.sum()))


def test_odd_rows_and_no_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert Counter(map(tuple, A.align_documents(odd).collect())) == brute(rows)[0]
    assert A.align_documents(none).count() == 0
