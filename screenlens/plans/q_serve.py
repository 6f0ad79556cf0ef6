"""Catalogue: the whole result bundle of a record, retrieval included (documents into advice, report and prompt)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import findings as H
from ..functions.text import norm_ws, tokenize
from ..operators import prompts as PM
from ..operators.corpus_index import CorpusIndex
from ..sources.tables import stored
from .catalog import query
from .q_retrieval import corpus, documents_of
from .q_text import RECORD_FIELDS, _scored


USED_CHARS = max(C.REFERENCE_CHARS, C.PROMPT_DOC_CHARS) + 1     # of a document's text; one more keeps a last space


def best_documents(queries: DataFrame, index: CorpusIndex, documents: Callable[[DataFrame], DataFrame],
                   top_k: int = C.DEFAULT_TOP_K) -> tuple[DataFrame, DataFrame]:
    """(qid, q) and (q, documents): the best ``top_k`` documents, best first, as an array of structs.

    Postings come from the stored index; only documents that are found are prepared.  Queries that have the same terms of
    the corpus share a ``q``, and their documents are found and joined once, with as much text as the outputs use.  Words
    that the corpus does not have are dropped before the queries' words are counted.
    """
    words = queries.select("qid", F.explode(tokenize(F.col("query"))).alias("term"))
    known = stored(index.known_terms(words), "known")
    asked = stored(words.join(known, "term").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")), "words")
    names, found = index.bm25_matches(asked, ["qid"], top_k, 9)
    ranked = stored(found, "ranked")
    used = F.substring(norm_ws(F.col("text")), 1, USED_CHARS).alias("text")
    corpus = documents(ranked.select("doc_id").distinct())
    found = ranked.join(corpus.select("doc_id", "title", "source", used, "type"), "doc_id")
    entry = F.struct("rank", "doc_id", "title", "source", "text", "type", "score")
    return names, found.groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("documents"))   # top_k entries


def document_texts(found: DataFrame) -> DataFrame:
    """q, document_ids, references, rag of (q, documents): what the texts take from the documents, once for each ``q``."""
    docs = F.col("documents")
    return found.select("q", F.transform(docs, lambda d: d["doc_id"]).alias("document_ids"),
                        H.reference_lines(docs).alias("references"), PM.rag_block(docs).alias("rag"))


@query("serve_records")
def q_serve_records(spark: SparkSession, sf: str) -> DataFrame:
    """Conclusion, documents, advice, report and prompt of every record."""
    parts = F.struct("final.source", "final.label", "final.diagnosis", "final.trace").alias("final")
    scored = stored(_scored(spark, sf).select("record_id", *RECORD_FIELDS, parts, "highlights", "query",
                                              F.md5("query").alias("qid")), "scored")    # read for the queries and at the end
    asked = stored(scored.select("qid", "query").distinct(), "queries")
    names, found = best_documents(asked, corpus(spark, sf), documents_of(spark, sf))
    texts = stored(document_texts(found), "texts")
    s = scored.join(names, "qid", "left").join(texts, "q", "left")
    refs = F.coalesce("references", F.array().cast("array<string>"))
    s = s.withColumn("advice_text", H.advice_struct(F.col("final.label"), F.col("highlights"), refs=refs)["text"])
    logic = F.when(F.col("final.source") == C.SOURCE_RULES, F.col("final.trace")).otherwise(
        F.array().cast("array<string>"))
    report = H.report_text(RECORD_FIELDS, F.col("final.label"), F.col("final.source"), F.col("final.diagnosis"), logic,
                           refs, F.col("advice_text"))
    prompt = PM.user_prompt(F.col("final.label"), F.col("final.diagnosis"), F.col("final.source"),
                            PM.evidence_block(F.col("final.source"), F.col("final.trace")),
                            PM.record_block(RECORD_FIELDS), F.col("query"), F.coalesce("rag", PM.rag_block(None)))
    ids = F.coalesce("document_ids", F.array().cast(texts.schema["document_ids"].dataType))
    return s.select("record_id", "final.source", "final.label", ids.alias("document_ids"), "advice_text",
                    report.alias("report"), F.lit(C.PROMPT_SYSTEM).alias("system_prompt"), prompt.alias("user_prompt"))
