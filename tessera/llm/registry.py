"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from . import (q_chat, q_dedup, q_html, q_language, q_manifest, q_mixing, q_pii, q_quality, q_repeats, q_secrets, q_tokens,
               q_whitening)

QUERIES = {
    "op1_exact_dedup": q_dedup.op1_exact_dedup,
    "op2_byte_bpe": q_tokens.op2_byte_bpe,
    "op3_language_id": q_language.op3_language_id,
    "op3_language_id_pages": q_language.op3_language_id_pages,
    "op4_chat_formatting": q_chat.op4_chat_formatting,
    "op5_minhash_near_dedup": q_dedup.op5_minhash_near_dedup,
    "op6_repeat_removal": q_repeats.op6_repeat_removal,
    "op7_quality_rules": q_quality.op7_quality_rules,
    "op8_personal_data": q_pii.op8_personal_data,
    "op9_html_extraction": q_html.op9_html_extraction,
    "op10_source_mixing": q_mixing.op10_source_mixing,
    "op11_merkle_manifest": q_manifest.op11_merkle_manifest,
    "op12_embedding_whitening": q_whitening.op12_embedding_whitening,
    "op13_secret_scan": q_secrets.op13_secret_scan,
}

ORACLE = {
    "op1_exact_dedup": q_dedup.OP1_SQL,
    "op4_chat_formatting": q_chat.OP4_SQL,
    "op11_merkle_manifest": q_manifest.OP11_SQL,
}
