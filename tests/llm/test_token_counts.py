from labelscope.llm import token_counts
from labelscope.llm.token_counts import Rollup, events


def totals(rollup, batches):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals(batches).collect()}


def test_deltas(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "d", "s", "en"), (3, None, None, None)], "doc_id long, text string, source string, lang string")
    rollup = Rollup(spark, str(tmp_path / "r"))
    rollup.commit("b1", events(docs, "insert", "words-1"), [])
    assert totals(rollup, ["b1"]) == {("s", "en", "words-1"): (2, 4), (None, None, "words-1"): (1, 0)}
    # Moved to another source with other text; deleted; deleted though never there; revised though never there.
    revised = spark.createDataFrame([(1, "x y", "t", "en"), (9, "q", "t", "en")], docs.schema)
    changes = events(revised, "revise", "words-1").unionByName(events(docs.where("doc_id = 2"), "delete", "words-1")).unionByName(
        events(docs.where("doc_id = 1"), "delete", "words-2"))
    for _ in range(2):  # committing again changes nothing
        rollup.commit("b2", changes, ["b1"])
        assert totals(rollup, ["b1", "b2"]) == {("t", "en", "words-1"): (1, 2), (None, None, "words-1"): (1, 0)}
    # A deleted document comes back; an inserted one that is live is a revision; the last event of a key holds.
    again = events(docs.where("doc_id = 2"), "insert", "words-1").unionByName(events(revised.where("doc_id = 1"), "insert", "words-1", 1)).unionByName(
        events(docs.where("doc_id = 1"), "delete", "words-1", 0))
    rollup.commit("b3", again, ["b1", "b2"])
    assert totals(rollup, ["b1", "b2", "b3"]) == {("s", "en", "words-1"): (1, 1), ("t", "en", "words-1"): (1, 2), (None, None, "words-1"): (1, 0)}
    assert {(r.doc_id, r.tokens) for r in rollup.live(["b1", "b2", "b3"]).collect()} == {(1, 2), (2, 1), (3, 0)}


def test_odd_rows(spark, odd, none, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "o"))
    rollup.commit("b0", events(none, "insert", "words-1"), [])
    assert totals(rollup, ["b0"]) == {}
    rollup.commit("b1", events(odd, "insert", "bytes-1").unionByName(events(odd, "insert", "words-2")), ["b0"])
    got = totals(rollup, ["b0", "b1"])
    assert sum(n for (*_, v), (n, _) in got.items() if v == "bytes-1") == 11  # a repeated row counts once
    assert totals(rollup, []) == {}


def test_tokenizers(spark):
    row = spark.createDataFrame([("a-b  cé",)], "text string")
    got = {v: row.select(f("text").alias("n")).first().n for v, f in ((k, token_counts.TOKENIZERS[k]) for k in token_counts.TOKENIZERS)}
    assert got == {"words-1": 2, "words-2": 5, "bytes-1": 9}
