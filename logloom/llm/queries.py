"""The registered queries of the corpus operators and their SQL."""

from . import chat, decontaminate, exact_dedup, language_id, lm_scoring, manifest, mixing, near_dedup, packing, secrets, structure_repair, suffix_dedup, token_counts

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_secrets": secrets.op6_secrets,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chat": chat.op8_chat,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_structure_repair": structure_repair.op12_structure_repair,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_secrets": secrets.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_chat": chat.SQL,
    "op12_structure_repair": structure_repair.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
