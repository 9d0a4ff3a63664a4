"""Registered queries of this package and their SQL oracles."""

from __future__ import annotations

from logharbor.llm import (
    bpe, decontam, filters, jaccard, links, mixing, pii, quality, repeats, secrets, toxicity, turns, vectors)

QUERIES = {f.__name__: f for f in (
    secrets.op1_secret_scan, quality.op2_quality_resampling, jaccard.op3_jaccard_join, links.op4_url_filter,
    pii.op5_personal_data, mixing.op6_mixing, decontam.op7_decontamination, vectors.op8_near_vectors,
    toxicity.op9_toxicity, repeats.op10_substring_dedup, turns.op11_conversation_repair, bpe.op12_byte_bpe,
    filters.op13_filter_audit, links.trust_of_trade)}

#: Where plain SQL expresses the operator; the others are tested by brute force.
ORACLES = {"op4_url_filter": links.OP4_SQL, "op6_mixing": mixing.OP6_SQL, "op11_conversation_repair": turns.OP11_SQL,
           "op13_filter_audit": filters.OP13_SQL, "trust_of_trade": links.TRADE_SQL}
