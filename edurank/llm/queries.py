"""Registered queries of the corpus operators, with checking SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edurank.llm import (
    chat, contamination, infill, linededup, manifest, neighbours, packing, passages, ppm, quality, simhash, tokens, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_partial_matching_lm": ppm.query,
    "op2_set_similarity_line_dedup": linededup.query,
    "op3_convolutional_toxicity": toxicity.query,
    "op4_markov_chat_format": chat.query,
    "op5_vantage_point_neighbours": neighbours.query,
    "op6_positional_decontamination": contamination.query,
    "op7_gated_attention_quality": quality.query,
    "op8_binary_packing": packing.query,
    "op9_phrase_automata_substring_dedup": passages.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_token_counts": tokens.query,
    "op12_merkle_manifest": manifest.query,
    "op13_fill_in_middle": infill.query,
}

ORACLES: dict[str, str] = {
    "op2_set_similarity_line_dedup": linededup.ORACLE,
    "op5_vantage_point_neighbours": neighbours.ORACLE,
    "op6_positional_decontamination": contamination.ORACLE,
    "op9_phrase_automata_substring_dedup": passages.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_fill_in_middle": infill.ORACLE,
}
