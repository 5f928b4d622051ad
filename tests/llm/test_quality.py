import re

from pyspark.sql import functions as F

from labelscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines)


def test_counts_equal_brute_force(spark, odd):
    extra = ["a b c a b c", "a a a a", "x\ny\nx\nx \n\n\n", "é# ß|<\x1f>\x85 q", "a b c d a b c", "one two"]
    docs = odd.where("doc_id <> 6").select("text").unionByName(spark.createDataFrame([(t,) for t in extra], "text string"))
    for r in docs.select("text", quality.counts_column(F.col("text")).alias("c")).collect():
        assert tuple(r.c) == brute(r.text), r.text


def test_word_hashes(monkeypatch):
    text = b"a b a ab ba \xc3\xa9 " + b"x" * 500 + b"\n" + b"y" * 501 + b" a\x1cb a\x85 q"
    whole = quality.word_hashes(text)
    words = text.split()
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    assert len({(w, h) for w, h in zip(words, whole.tolist(), strict=True)}) == len(set(words))
    monkeypatch.setattr(quality, "_CHUNK", 7)
    assert quality.word_hashes(text).tolist() == whole.tolist()
    many = " ".join(f"{a}{b}" for a in range(300) for b in "abcdefghij" * 3).encode()
    assert len(set(quality.word_hashes(many).tolist())) == 3000


def judge(docs):
    rows = quality.judged(docs, ["doc_id"])
    hosts = quality.host_verdicts(rows.select("host", (F.col("base_failed") | (F.col("soft_failed") > 0)).alias("failed")))
    return hosts, quality.with_host_verdict(rows, hosts).withColumn("kept", quality.verdict())


def documents(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    odd = clean + " #" * 8
    rows = [(i, odd if i % 10 else clean, "bad") for i in range(40)] + [(100 + i, clean, f"h{i % 5}") for i in range(200)]
    rows += [(400, odd, "h1"), (401, "short", "h2"), (402, clean + " #" * 70, "h3"), (403, odd, None), (404, odd, "tiny")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdicts(spark):
    hosts, rows = judge(documents(spark))
    found = {r.host: r for r in hosts.collect()}
    assert found["bad"].bad and not found["h1"].bad and found[None].n_docs == 1
    assert 0.5 < found["bad"].rate < 36 / 40 and 0 < found["h1"].rate < 1 / 41 + 0.1  # shrunk towards all hosts
    kept = {r.doc_id: r.kept for r in rows.collect()}
    assert not kept[1] and kept[0]  # a soft failure counts on a bad host, where clean documents stay
    assert kept[400] and not kept[401] and not kept[402]


def test_shuffled_join_equals_broadcast(spark, monkeypatch):
    _, rows = judge(documents(spark))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    _, salted = judge(documents(spark))
    columns = sorted(rows.columns)
    assert sorted(map(str, rows.select(*columns).collect())) == sorted(map(str, salted.select(*columns).collect()))


def test_odd_rows(spark, odd, none):
    _, rows = judge(odd)
    assert rows.count() == odd.count()
    failed = {r.doc_id: r.base_failed for r in rows.collect()}
    assert all(failed[i] for i in (1, 3, 4, 5, 7, 8, 9, 10, None))  # without words, too short, or one line again and again
    hosts, nothing = judge(none)
    assert hosts.count() == nothing.count() == 0


def test_stage_keeps_columns(spark, odd):
    kept = quality.stage_quality(spark, odd, "")
    assert kept.columns == odd.columns and not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}
