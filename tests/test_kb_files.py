"""Knowledge-base files, Chinese tokens, unknown labels, checkpoint folder."""

import json

import pytest
from pyspark.sql import functions as F

from screenlens.functions.text import tokenize
from screenlens.operators.retrieval import bm25_index, kb_from_json
from screenlens.plans.catalog import _label_codes
from screenlens.sources import fixtures as X

ITEMS = [{"title": "高血压复查", "text": "建议复查血压。职业禁忌证：高血压，噪声作业", "metric_name": "",
          "system_target": "血压", "keywords": ["收缩压", "舒张压"], "type": "note"},
         {"chunk_id": "c-9", "dense_text": "听力损失 noise 85dB", "source": "标准", "hazard": "噪声"}]


def test_tokens_of_chinese_text(spark):
    texts = ["建议复查血压。高血压 ABC12x，听", "plain Words 12", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokenize("t").alias("k")).collect()
    assert [r["k"] for r in rows] == [["建议", "议复", "复查", "查血", "血压", "高血", "血压", "abc12x", "听"],
                                      ["plain", "words", "12"], [], []]


def test_kb_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(ITEMS, ensure_ascii=False, indent=2), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps(ITEMS[1], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "more.jsonl").write_text("\n".join([json.dumps({"text": "first"}), "", "broken {",
                                                    json.dumps({"metric_name": "m2", "text": "second"})]) + "\n")
    (tmp_path / "notes.txt").write_text("left out")
    kb = {r["doc_id"]: r for r in kb_from_json(spark, str(tmp_path)).collect()}
    assert set(kb) == {"rules_0", "c-9", "more_0", "more_2"}
    first = kb["rules_0"]
    assert (first["title"], first["source"], first["metric_name"], first["type"]) == (
        "高血压复查", "rules.json", "血压", "note")
    assert "收缩压" in first["search_text"] and first["text"].startswith("建议复查")
    assert (kb["more_0"]["title"], kb["more_2"]["title"]) == ("more", "m2")
    assert kb["c-9"]["text"] == "听力损失 noise 85dB" and kb["c-9"]["hazard"] == "噪声"
    index = bm25_index(kb_from_json(spark, str(tmp_path)).where("doc_id <> 'c-9'"))
    assert {r["doc_id"] for r in index.where("term = '血压'").collect()} == {"rules_0"}


def test_unknown_label_is_an_error(spark, sf):
    df = X.exam(spark, sf).limit(20).withColumn("label", F.when(F.col("record_id") % 2 == 0, "no such label")
                                                 .otherwise(F.lit("other")))
    with pytest.raises(Exception, match="unknown label"):
        _label_codes(spark, df).collect()


def test_nothing_stays_cached_after_numbering(spark):
    from screenlens.operators.ids import append_ids
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert append_ids(spark.range(50), ["id"], 7, "n").agg(F.max("n")).first()[0] == 57
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_checkpoint_folder_is_required_off_local(monkeypatch):
    from screenlens.sources import tables

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.ensure_checkpoint_dir(Session())
