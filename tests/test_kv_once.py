"""A key/value text is parsed once, not once for each of its entries; rare line ends inside a line keep their meaning."""

from pyspark.sql import functions as F

from screenlens.sources.records_text import kv_entries


def test_lines_are_split_once(spark):
    df = spark.createDataFrame([("a: 1\nb：2: x\r\n a : 3 \n: no key\nnothing",)], "t string")
    out = df.select(kv_entries(F.col("t")).alias("e"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") <= 2           # the plain form and the one for rare line ends
    assert [tuple(e) for e in out.first()["e"]] == [("b", "2: x"), ("a", "3")]


def test_rare_line_ends(spark):
    texts = ["a\u2028b: 1", "a: 1\u2028", "a: 1\u20282", "a：\u0085x\nb: 2", None, ":", "：："]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r["i"]: [tuple(e) for e in r["e"]] for r in df.select("i", kv_entries(F.col("t")).alias("e")).collect()}
    assert out == {0: [], 1: [("a", "1")], 2: [("a", "")], 3: [("a", ""), ("b", "2")], 4: [], 5: [], 6: []}
