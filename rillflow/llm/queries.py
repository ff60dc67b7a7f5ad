"""The registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from rillflow.llm import op01_templates, op02_styletree, op03_bagminhash, op04_toxicity, op05_mixing, op06_quality, op07_crf, op08_ngram_trie, op09_shards, op10_linededup

QUERIES = {
    "op1_templates": op01_templates.query,
    "op2_styletree": op02_styletree.query,
    "op3_bagminhash": op03_bagminhash.query,
    "op4_toxicity": op04_toxicity.query,
    "op5_mixing": op05_mixing.query,
    "op6_quality": op06_quality.query,
    "op7_crf": op07_crf.query,
    "op8_ngram_trie": op08_ngram_trie.query,
    "op9_shards": op09_shards.query,
    "op10_linededup": op10_linededup.query,
}

ORACLES: dict[str, str] = {
    "op5_mixing": op05_mixing.ORACLE,
    "op6_quality": op06_quality.ORACLE,
    "op10_linededup": op10_linededup.ORACLE,
}
