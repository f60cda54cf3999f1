"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, fixity, flac, mixing, neardup, preferences, quality, rule_classifier, sharding

QUERIES = {
    "op1_histogram_shards": sharding.op1_query,
    "op2_token_counts": bpe.op2_query,
    "op3_preference_pairs": preferences.op3_query,
    "op4_quality_rules": quality.op4_query,
    "op5_warc_fixity": fixity.op5_query,
    "op6_probminhash_near_dedup": neardup.op6_query,
    "op7_rule_ensemble": rule_classifier.op7_query,
    "op8_flac_media": flac.op8_query,
    "op9_bpe_round_trip": bpe.op9_query,
    "op10_mix_sources": mixing.op10_query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference_pairs": preferences.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_warc_fixity": fixity.OP5_SQL,
}
