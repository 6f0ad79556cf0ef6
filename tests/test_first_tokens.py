"""The first two tokens of a text equal those of all its tokens."""

from pyspark.sql import functions as F

from screenlens.functions.text import first_tokens, tokenize

TEXTS = ["", None, " -- ", "Alpha", "Alpha, BETA gamma", "  ..a1--b2", "粉尘作业 dust", "dust 粉 noise", "x粉尘y z", "İstanbul a",
         "a" * 5000, "é ß　x", "1.5 mg", "噪", "tab\tnew\nline", "½ a", "áb c"]


def test_first_two(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    one, two = first_tokens("t")
    got = rows.select(one.alias("a"), two.alias("b"), tokenize("t").alias("all")).collect()
    for r in got:
        assert [r["a"], r["b"]] == [*r["all"], "", ""][:2]
