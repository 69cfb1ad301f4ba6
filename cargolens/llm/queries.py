"""The subpackage's queries and the SQL that states their results."""

from . import exact_dedup, line_crf, lm, minhash, mixing, packing, pii, prefix_trie, quality_rules, repair, secrets, token_counts, warc


def queries() -> dict:
    return {
        "op1_quality_classifier": line_crf.op1_quality_classifier,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_lm_scoring": lm.op3_lm_scoring,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_pii": pii.op5_pii,
        "op6_warc": warc.op6_warc,
        "op7_mixing": mixing.op7_mixing,
        "op8_secrets": secrets.op8_secrets,
        "op9_packing": packing.op9_packing,
        "op10_minhash": minhash.op10_minhash,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op4_quality_rules": quality_rules.OP4_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_minhash": minhash.OP10_SQL,
        "op12_conversation_repair": repair.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
