import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscope.llm import infill


def brute(doc_id, text, parted=100, suffix_first=50):
    """``(n, form, prefix_chars, middle_chars, output)`` from the definition, over code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= parted:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_texts(count, seed=3):
    draw = random.Random(seed)
    parts = ["\n", "\n\n", "a", "<", "<P", "<S", ">", "P>", "é", "日", "😀", "line of words\n", " ", "\r\n", "<X>", "\x00", "\x85", " "]
    return [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for i in range(count)]


def test_texts_and_digests_equal_the_definition(spark):
    rows = random_texts(400) + [(500, "has <S> inside\n" * 3), (501, None), (None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (502, "x" * 99_999 + "\n" + "y\n" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter((d, *brute(d, t)) for d, t in rows)
    assert Counter(map(tuple, infill.fill_in_middle(docs).collect())) == want
    digests = infill.restored_digests(infill.restoring_pieces(infill.output_pieces(docs)))
    assert Counter(map(tuple, digests.collect())) == Counter((d, *brute(d, t)[:4], sha(brute(d, t)[4]), sha(t or "")) for d, t in rows)


@pytest.mark.parametrize("size", [1, 2, 5, 17])
def test_sentinels_and_lines_over_borders_of_pieces(size):
    for doc_id, text in random_texts(300, seed=size):
        known, pieces = infill.cut_text(doc_id, text.encode(), size=size)
        n, form, prefix, middle, output = brute(doc_id, text)
        assert known == (n, form, prefix, middle) and b"".join(pieces) == output.encode()
        # Read back in pieces of any cut, which may part a sentinel.
        whole, reader, found = output.encode(), infill._Reader(form), []
        for at in range(0, len(whole), size):
            found += reader.parts(whole[at:at + size])
        found += reader.parts(b"", last=True)
        assert b"".join(body for *_, body in sorted(found)) == text.encode()


def test_rates(spark):
    rates = infill.Rates(parted=30, suffix_first=0)
    rows = random_texts(200)
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rates).collect()}
    assert got == {d: brute(d, t, 30, 0) for d, t in rows}
    assert {v[1] for v in got.values()} == {"plain", "psm"}


def test_odd_rows_and_no_rows(spark, odd, none):
    got = infill.restored_digests(infill.restoring_pieces(infill.output_pieces(odd)))
    want = Counter((r.doc_id, *brute(r.doc_id, r.text)[:4], sha(brute(r.doc_id, r.text)[4]), sha(r.text or "")) for r in odd.select("doc_id", "text").collect())
    assert Counter(map(tuple, got.collect())) == want
    assert infill.fill_in_middle(none).count() == 0
    assert infill.restored_digests(infill.restoring_pieces(infill.output_pieces(none))).count() == 0


def test_one_exchange(spark, odd):
    frame = infill.restored_digests(infill.restoring_pieces(infill.output_pieces(odd)))
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert frame.where(F.col("form").isNull()).count() == 0
