"""The text operators' queries and oracle SQL."""

from __future__ import annotations

from quantloom.llm import chat, conv_trie, decontaminate, exact_dedup, licenses, line_templates, mixing, near_dedup, pii, pitman_yor, quality, spelling, warc

QUERIES = {
    "op1_weak_pii": pii.op1_weak_pii,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_probminhash": near_dedup.op5_probminhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc_round_trip": warc.op7_warc_round_trip,
    "op8_line_crf": quality.op8_line_crf,
    "op9_log_templates": line_templates.op9_log_templates,
    "op10_chat_roles": chat.op10_chat_roles,
    "op11_pitman_yor": pitman_yor.op11_pitman_yor,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_prefix_trie": conv_trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_warc_round_trip": warc.OP7_SQL,
    "op13_prefix_trie": conv_trie.OP13_SQL,
}
