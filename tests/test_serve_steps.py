"""Records are scored once for serving, and what texts take from documents is made once for each group of queries."""

from pyspark.sql import functions as F

from screenlens import constants as C
from screenlens.functions import findings as H
from screenlens.operators import prompts as PM
from screenlens.operators.corpus_index import CorpusIndex
from screenlens.plans import q_serve
from screenlens.plans.registry import all_queries


def test_scored_rows_are_read_not_joined_again(spark, sf):
    plan = all_queries()["serve_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and "Window" not in plan      # with the groups of queries, twice, and with the texts


def test_texts_of_documents(spark):
    entry = "array<struct<rank:int,doc_id:bigint,title:string,source:string,text:string,type:string,score:double>>"
    docs = [(i + 1, 10 + i, f"t{i}" if i else None, f"s{i}" if i != 1 else None, f" a  b{i} " * 60, "note", 1.0)
            for i in range(5)]
    found = spark.createDataFrame([(1, docs), (2, docs[:1]), (3, [])], f"q long, documents {entry}")
    col = F.col("documents")
    before = {r["q"]: r for r in found.select("q", H.reference_lines(col).alias("refs"), PM.rag_block(col).alias("rag"),
                                              H.advice_struct(F.lit("normal"), F.array(F.lit("x")), col)["text"].alias("advice")
                                              ).collect()}
    texts = q_serve.document_texts(found)
    refs = F.col("references")
    for r in texts.select("*", H.advice_struct(F.lit("normal"), F.array(F.lit("x")), refs=refs)["text"].alias("a")).collect():
        b = before[r["q"]]
        assert (r["references"], r["rag"], r["a"]) == (b["refs"], b["rag"], b["advice"])
        assert len(r["document_ids"]) == {1: 5, 2: 1, 3: 0}[r["q"]]
    assert before[3]["rag"] == C.PROMPT_NO_DOCS


def test_words_of_the_corpus(spark, tmp_path):
    kb = spark.createDataFrame([(1, "dust noise"), (2, "dust")], "doc_id long, search_text string")
    index = CorpusIndex(spark, str(tmp_path / "a"))
    index.add(kb)
    asked = spark.createDataFrame([("dust",), ("other",), ("dust",), (None,)], "term string")
    assert [r["term"] for r in index.known_terms(asked).collect()] == ["dust"]
