"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import chat_format, hnsw, html_text, line_rules, mixing, ngram_join, packing, prefix_trie, sharding, toxicity, turn_repair, url_filter
from ledgerline.llm.common import table
from ledgerline.llm.fingerprints import edit_likeness


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_frequency_rules(table(spark, sf_dir, "documents")).drop("host", "t1", "t2", "removed_lines")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("place", "text_hash")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.toxic_pages(pages, table(spark, sf_dir, "labels")))


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_digests(chat_format.with_probe(table(spark, sf_dir, "conversations")))


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_digests(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_line_frequency": op2_line_frequency,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_source_mix": op4_source_mix,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_bloom": op6_url_bloom,
    "op7_chat_round_trip": op7_chat_round_trip,
    "op8_line_blocks": op8_line_blocks,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_toxicity_trees": op10_toxicity_trees,
    "op11_turn_repair": op11_turn_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hnsw": op13_hnsw,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_frequency": line_rules.ORACLE_SQL,
    "op4_source_mix": mixing.ORACLE_SQL,
    "op5_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op6_url_bloom": url_filter.ORACLE_SQL,
    "op7_chat_round_trip": chat_format.ORACLE_SQL,
    "op8_line_blocks": html_text.ORACLE_SQL,
    "op11_turn_repair": turn_repair.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
