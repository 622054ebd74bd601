"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunks, conversations, divergence, exact_dedup, language, mixing, packing, parity_join, personal, quality, repair, suffix_dedup, telephony

QUERIES = {
    "op1_repair": repair.op1_repair,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_length_buckets": packing.op3_length_buckets,
    "op4_suffix_array": suffix_dedup.op4_suffix_array,
    "op5_telephony": telephony.op5_telephony,
    "op6_parity_join": parity_join.op6_parity_join,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_quality": quality.op8_quality,
    "op9_gear_chunks": chunks.op9_gear_chunks,
    "op10_contextual_pii": personal.op10_contextual_pii,
    "op11_language_kernel": language.op11_language_kernel,
    "op12_divergence": divergence.op12_divergence,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_length_buckets": packing.OP3_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op12_divergence": divergence.OP12_SQL,
}
