"""Queries of this subpackage: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from . import chat, exact_dedup, hard_negatives, html_text, mixing, neighbours, packing, pii, prefix_trie, quality, rules, simhash, token_counts
from .shared import table


def _documents(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents", ["doc_id", "text", *more])


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels", ["doc_id", "quality"])


QUERIES = {
    "op1_pii": lambda spark, sf_dir: pii.op1_pii(_documents(spark, sf_dir)),
    "op2_packing": lambda spark, sf_dir: packing.pack(_documents(spark, sf_dir)),
    "op3_chat": lambda spark, sf_dir: chat.op3_chat(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])),
    "op3_chat_calls": lambda spark, sf_dir: chat.op3_chat(chat.planted_calls(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))),
    "op4_quality": lambda spark, sf_dir: quality.op4_quality(_documents(spark, sf_dir), _labels(spark, sf_dir)),
    "op5_simhash": lambda spark, sf_dir: simhash.op5_simhash(_documents(spark, sf_dir)),
    "op6_rules": lambda spark, sf_dir: rules.op6_rules(_documents(spark, sf_dir), _labels(spark, sf_dir)),
    "op7_mixing": lambda spark, sf_dir: mixing.op7_mixing(_documents(spark, sf_dir, "source")),
    "op8_exact_dedup": lambda spark, sf_dir: exact_dedup.op8_exact_dedup(_documents(spark, sf_dir)),
    "op9_html": lambda spark, sf_dir: html_text.extract(table(spark, sf_dir, "pages", ["page_id", "url", "html"])),
    "op10_token_counts": lambda spark, sf_dir: token_counts.count_tokens(_documents(spark, sf_dir)),
    "op11_hard_negatives": lambda spark, sf_dir: hard_negatives.op11_hard_negatives(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])),
    "op12_prefix_trie": lambda spark, sf_dir: prefix_trie.op12_prefix_trie(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])),
    "op13_neighbours": lambda spark, sf_dir: neighbours.op13_neighbours(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])),
}

ORACLES = {
    "op3_chat": chat.ORACLE_SQL, "op3_chat_calls": chat.CALLS_SQL, "op7_mixing": mixing.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
