"""Queries of the numbered operators and their DuckDB equivalents."""

from __future__ import annotations

from tarn.llm import chat, decontaminate, interaction, lm, mixing, neardup, pii, quality, secrets, sharding, spelling, suffixdedup, topk

QUERIES = {
    "op1_dual_tree_top_k": topk.top_k_query,
    "op2_karmarkar_karp_shards": sharding.shard_query,
    "op3_chain_field_pii": pii.personal_data_query,
    "op4_chat_role_repair": chat.chat_query,
    "op5_suffix_array_decontamination": decontaminate.decontaminate_query,
    "op6_forest_secret_scan": secrets.secrets_query,
    "op7_attention_mil_quality": quality.quality_query,
    "op8_induced_suffix_dedup": suffixdedup.suffix_dedup_query,
    "op9_dart_minhash_near_dedup": neardup.near_duplicate_query,
    "op10_entropy_balanced_mix": mixing.mix_query,
    "op11_lehmer_interaction_audit": interaction.interaction_query,
    "op12_kd_tree_spelling": spelling.spelling_query,
    "op13_causal_attention_lm": lm.lm_query,
}
ORACLES: dict[str, str] = {
    "op1_dual_tree_top_k": topk.TOP_K_SQL,
    "op5_suffix_array_decontamination": decontaminate.DECONTAMINATE_SQL,
    "op8_induced_suffix_dedup": suffixdedup.SUFFIX_DEDUP_SQL,
    "op9_dart_minhash_near_dedup": neardup.NEAR_DUPLICATE_SQL,
    "op11_lehmer_interaction_audit": interaction.INTERACTION_SQL,
    "op12_kd_tree_spelling": spelling.SPELLING_SQL,
}
