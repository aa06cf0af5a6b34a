"""Queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from threadlake.llm import bpe, exact_dedup, hard_negatives, html_text, license_scan, minhash, packing, prefix_trie, quality, substring, topk, toxicity, url_filter

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_minhash": minhash.op6_minhash,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_top_k": topk.op9_top_k,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_quality": quality.op13_quality,
}

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_minhash": minhash.OP6_SQL,
    "op7_substring_dedup": substring.OP7_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
