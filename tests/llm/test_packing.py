import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from labelscope.llm import packing, repair
from labelscope.llm.subwords import CachedTokenizer

ALPHABET = [" ", "  ", "\n", "\n\n", "a", "E", "th", "the", "é", "é", "ﬁ", "日", "x", "<|endoftext|>", ".", "!", "ing", "\t", "\x00", "1", "22",
            "😀", "'s", "'", " \n", " ", "\x1c", "İ", "Σ", "µ", "'LL"]


def test_ids_equal_the_library_on_random_texts():
    draw = random.Random(3)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "it's the cats' don't\n\nand  more \n", "word " * 3000]
    for path in (packing.TOKENIZER, repair.TOKENIZER):
        own, library = CachedTokenizer(path, limit=500), Tokenizer.from_file(path)
        wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for at in range(0, len(texts), 300):
            for text, got, want in zip(texts[at:at + 300], own.encode_batch(texts[at:at + 300]), wanted[at:], strict=False):
                assert np.frombuffer(got, "<u4").tolist() == want, (path, text)


def packed(lengths, capacity):
    packer, out = packing.Packer(capacity), []
    for i, n in enumerate(lengths):
        out += list(packer.add(i, np.arange(n, dtype="<u4") + i))
    return out + list(packer.finish())


def test_every_id_lies_in_one_piece_and_sequences_are_full():
    draw = random.Random(8)
    for capacity in (1, 7, 16, 4096):
        lengths = [draw.choice((0, 1, 2, draw.randint(0, capacity), draw.randint(0, 5 * capacity))) for _ in range(300)]
        sequences = packed(lengths, capacity)
        seen = {i: [] for i in range(len(lengths))}
        for pieces in sequences:
            total = sum(len(p.ids) for p in pieces)
            assert total == capacity or total < capacity and total & (total - 1) == 0
            for p in pieces:
                assert len(p.ids) and p.doc_tokens == lengths[p.doc_id]
                seen[p.doc_id].append((p.start, p.ids))
        for i, own in seen.items():
            own.sort(key=lambda x: x[0])
            assert np.array_equal(np.concatenate([np.zeros(0, "<u4"), *(x for _, x in own)]), np.arange(lengths[i]) + i)
            assert [a for a, _ in own] == np.cumsum([0, *(len(x) for _, x in own)])[:len(own)].tolist()


def test_classes_hold_a_fixed_number_of_whole_documents():
    assert [[len(p.ids) for p in s] for s in packed([30, 30, 30], 90)] == [[30, 30, 30]]
    # Class 2 closes with two documents; the next one's head fills its slack.
    assert [[len(p.ids) for p in s] for s in packed([40, 35, 40], 90)][0] == [40, 35, 15]


def test_pack(spark, odd, none):
    library = Tokenizer.from_file(packing.TOKENIZER)
    source = odd.coalesce(3)
    out = packing.pack(source, with_ids=True).toPandas()
    assert len(out) and packing.pack(none).count() == 0
    assert (out.ids.map(zlib.crc32) == out.ids_crc32).all() and (out.ids.map(len) == 4 * out.length).all()
    for _, own in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all()
        total = own.length.sum()
        assert total == 4096 or total < 4096 and total & (total - 1) == 0
    wanted = sorted(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for r in odd.collect())
    whole = sorted(b"".join(own.ids) for _, own in out[out.doc_id != 1].sort_values("start").groupby("doc_id", dropna=False))
    assert all(x in wanted for x in whole) and out.length.sum() == sum(map(len, wanted)) // 4
    assert out[out.doc_id == 3][["start", "length", "doc_tokens"]].values.tolist() == [[0, 1, 1]]
