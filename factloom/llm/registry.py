"""The numbered queries, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, lm, near, packing, quality, sharding, suffix, toxicity, trie, vectors, whitening


def queries():
    return {
        "op1_hierarchical_packing": packing.op1_hierarchical_packing,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_bounded_ring": sharding.op3_bounded_ring,
        "op4_event_chat": chat.op4_event_chat,
        "op5_kneser_ney": lm.op5_kneser_ney,
        "op6_token_group_join": near.op6_token_group_join,
        "op7_bit_sliced_topk": vectors.op7_bit_sliced_topk,
        "op8_cover_tree_dedup": vectors.op8_cover_tree_dedup,
        "op9_zstd_toxicity": toxicity.op9_zstd_toxicity,
        "op10_segment_tree_bpe": bpe.op10_segment_tree_bpe,
        "op11_qd_whitening": whitening.op11_qd_whitening,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_zstd_quality": quality.op13_zstd_quality,
    }


def oracle_sql():
    return {"op4_event_chat": chat.OP4_SQL, "op6_token_group_join": near.OP6_SQL, "op7_bit_sliced_topk": vectors.OP7_SQL, "op8_cover_tree_dedup": vectors.OP8_SQL, "op12_prefix_trie": trie.OP12_SQL}
