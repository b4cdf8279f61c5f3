"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quillmill.llm import ann, bpe, exact_dedup, heavy, jaccard, lattice_lm, mixing, pii, quality, repeats, resampling, token_orc, warc

QUERIES = {
    "op1_capped_water_filling": mixing.op1_capped_water_filling,
    "op2_lattice_likelihood": lattice_lm.op2_lattice_likelihood,
    "op3_content_sort": exact_dedup.op3_content_sort,
    "op4_two_tier_bpe": bpe.op4_two_tier_bpe,
    "op5_semi_markov_pii": pii.op5_semi_markov_pii,
    "op6_orc_tokens": token_orc.op6_orc_tokens,
    "op7_signature_trees": jaccard.op7_signature_trees,
    "op8_line_crf": quality.op8_line_crf,
    "op9_grouped_suffix_array": repeats.op9_grouped_suffix_array,
    "op10_anisotropic_search": ann.op10_anisotropic_search,
    "op11_crc_resampling": resampling.op11_crc_resampling,
    "op12_heavy_hitters": heavy.op12_heavy_hitters,
    "op13_warc_revisits": warc.op13_warc_revisits,
}

SQL = {
    "op1_capped_water_filling": mixing.OP1_SQL,
    "op3_content_sort": exact_dedup.OP3_SQL,
    "op13_warc_revisits": warc.OP13_SQL,
}
