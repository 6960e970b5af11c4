"""The queries of this subpackage: one for each operator."""

from __future__ import annotations

from . import ann, bpe, chat, filter_audit, licenses, lines, minhash, oracle, packing, prefix_trie, rule_ledger, semdedup, sharding, toxicity


def queries() -> dict:
    found = [chat.op1_chat_format, lines.op2_line_dedup, semdedup.op3_embedding_dedup, ann.op4_one_bit_codes, bpe.op5_byte_bpe, minhash.op6_bag_minhash, toxicity.op7_toxicity, packing.op8_packing, licenses.op9_license_templates, sharding.op10_sampled_splitters]
    found += [filter_audit.op11_filter_audit, prefix_trie.op12_prefix_trie, rule_ledger.op13_rule_ledger]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
