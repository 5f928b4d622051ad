import json

from pyspark.sql import functions as F

from labelscope.functions import canonical


def test_ascii_json_is_that_of_python_with_few_and_many_odd_characters(spark):
    texts = ["", "plain", "é", "éé日\U0001F600é", "a\\u00E9é", "\x01é\x1f", "".join(map(chr, range(0x100, 0x100 + canonical.FEW))),
             "".join(map(chr, range(0x100, 0x101 + canonical.FEW))) * 2, "퟿￿\U00010000\U0010ffff"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical.canonical_json(F.struct("t"), ascii_only=True).alias("j"))
    for i, j in rows.collect():
        assert j == json.dumps({"t": texts[i]}, separators=(",", ":"))


def test_few_odd_characters_are_replaced_without_taking_the_text_apart(spark, monkeypatch):
    monkeypatch.setattr(canonical, "_TOKENS", "(")  # a pattern that fails where it is used
    frame = spark.createDataFrame([("é日" * 50,)], "t string").select(canonical.canonical_json(F.struct("t"), ascii_only=True))
    assert frame.first()[0] == json.dumps({"t": "é日" * 50}, separators=(",", ":"))
