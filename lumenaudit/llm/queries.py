"""The queries that this subpackage registers, and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, langid, lm, minhash, quality, spelling, spiece, suffix, tokenfile, topk, toxicity, trie

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_top_k": topk.op2_top_k,
    "op3_lm_score": lm.op3_lm_score,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_sentencepiece": spiece.op5_sentencepiece,
    "op6_language_id": langid.op6_language_id,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_ids": tokenfile.op9_token_ids,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
    "op11_minhash": minhash.op11_minhash,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {"op2_top_k": topk.ORACLE, "op4_ngram_jaccard": jaccard.ORACLE, "op10_suffix_dedup": suffix.ORACLE, "op11_minhash": minhash.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_spelling_variants": spelling.ORACLE}
