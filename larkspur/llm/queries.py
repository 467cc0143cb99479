"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from larkspur.llm import chat, decontam, metric, neardup, negatives, ngrams, packing, phrases, quality, rules, sharding, substrings, warc

QUERIES = {
    "op1_elias_fano_ngrams": ngrams.query,
    "op2_warc_salvage": warc.query,
    "op3_lookup_sharding": sharding.query,
    "op4_tensored_minhash": neardup.query,
    "op5_fingerprint_index": substrings.query,
    "op6_complement_packing": packing.query,
    "op7_risk_controlled_rules": rules.query,
    "op8_chat_events": chat.query,
    "op9_winnowing_decontamination": decontam.query,
    "op10_random_indexing_quality": quality.query,
    "op11_metric_space_join": metric.query,
    "op12_radius_bounded_negatives": negatives.query,
    "op13_pattern_growth_phrases": phrases.query,
}

ORACLE_SQL = {
    "op2_warc_salvage": warc.ORACLE_SQL,
    "op3_lookup_sharding": sharding.ORACLE_SQL,
    "op4_tensored_minhash": neardup.ORACLE_SQL,
    "op5_fingerprint_index": substrings.ORACLE_SQL,
    "op7_risk_controlled_rules": rules.ORACLE_SQL,
    "op8_chat_events": chat.ORACLE_SQL,
    "op9_winnowing_decontamination": decontam.ORACLE_SQL,
    "op11_metric_space_join": metric.ORACLE_SQL,
    "op12_radius_bounded_negatives": negatives.ORACLE_SQL,
    "op13_pattern_growth_phrases": phrases.ORACLE_SQL,
}
