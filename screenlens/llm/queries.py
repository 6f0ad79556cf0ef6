"""Queries of the dealt operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from screenlens.sources.tables import read_table

from . import (
    op1_decontaminate,
    op2_quality,
    op3_minhash,
    op4_paragraphs,
    op5_wordpiece,
    op6_licenses,
    op7_urls,
    op8_bpe,
    op9_shards,
    op10_suffix,
    op11_filter_audit,
    op12_simhash,
    op13_spelling,
)
from .common import importable_on_workers


def _tables(spark, sf_dir, *wanted):
    """The named tables with the columns a query reads: (name, column, ...) each."""
    importable_on_workers(spark)
    return [read_table(spark, sf_dir, name, *columns) for name, *columns in wanted]


DOCUMENTS = ("documents", "doc_id", "text")


def op1_decontaminate_items(spark, sf_dir):
    """Leaks: (doc_id, item_id, distance, places), documents without a leak do not appear."""
    return op1_decontaminate.decontaminate(*_tables(spark, sf_dir, DOCUMENTS, ("benchmark", "item_id", "text")))


def op2_quality_rules(spark, sf_dir):
    judged = op2_quality.quality_rules(*_tables(spark, sf_dir, DOCUMENTS, ("labels", "doc_id", "quality")))
    return judged.select("doc_id", *op2_quality.BASE, "base_failed", "kept", "score")


def op3_near_duplicates(spark, sf_dir):
    return op3_minhash.near_duplicates(*_tables(spark, sf_dir, DOCUMENTS))


def op4_paragraph_dedup(spark, sf_dir):
    """Occurrences of repeated paragraphs and windows; documents without one do not appear."""
    return op4_paragraphs.repeated_passages(*_tables(spark, sf_dir, DOCUMENTS))


def op5_token_counts(spark, sf_dir):
    return op5_wordpiece.token_counts(*_tables(spark, sf_dir, DOCUMENTS),
                                      public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_license_scan(spark, sf_dir):
    return op6_licenses.license_scan(*_tables(spark, sf_dir, DOCUMENTS))


def op7_url_filter(spark, sf_dir):
    return op7_urls.url_filter(*_tables(spark, sf_dir, ("pages", "page_id", "url")))


def op8_byte_bpe(spark, sf_dir):
    return op8_bpe.digests(*_tables(spark, sf_dir, DOCUMENTS), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


def op9_shard_shuffle(spark, sf_dir):
    return op9_shards.report(*_tables(spark, sf_dir, DOCUMENTS))


def op10_suffix_dedup(spark, sf_dir):
    return op10_suffix.repeats(*_tables(spark, sf_dir, DOCUMENTS))


def op11_filter_audit_orders(spark, sf_dir):
    """Counts per part, filter order and step."""
    return op11_filter_audit.filter_audit(*_tables(spark, sf_dir, ("documents", "doc_id", "text", "source"),
                                                   ("labels", "doc_id", "quality", "toxic")))


def op12_simhash_groups(spark, sf_dir):
    return op12_simhash.simhash_groups(*_tables(spark, sf_dir, DOCUMENTS))


def op13_spelling_variants(spark, sf_dir):
    """Words with their form and root."""
    return op13_spelling.variant_groups(*_tables(spark, sf_dir, DOCUMENTS))


QUERIES = {
    "op1_decontaminate": op1_decontaminate_items,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_shard_shuffle": op9_shard_shuffle,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit_orders,
    "op12_simhash": op12_simhash_groups,
    "op13_spelling": op13_spelling_variants,
}
