"""Registered corpus queries and their SQL twins."""

from __future__ import annotations

from shelfspark.llm import bpe, contamination, language, merkle, mixing, pii, quality, scoring, search, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_warc": warc.query,
    "op3_language": language.query,
    "op4_pii": pii.query,
    "op5_simhash": simhash.query,
    "op8_quality": quality.query,
    "op9_scoring": scoring.query,
    "op10_decontaminate": contamination.query,
    "op6_token_counts": token_counts.query,
    "op7_toxicity": toxicity.query,
    "op11_merkle": merkle.query,
    "op12_search": search.query,
    "op13_bpe": bpe.query,
}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_warc": warc.ORACLE,
    "op8_quality": quality.ORACLE,
    "op10_decontaminate": contamination.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_search": search.ORACLE,
}
