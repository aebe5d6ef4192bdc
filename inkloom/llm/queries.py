"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from inkloom.llm import ann, jaccard, langid, lines, mixing, packing, repeats, topk, toxicity, warc

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_cross_polytope": ann.op2_cross_polytope,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_best_fit": packing.op4_best_fit,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_language_id": langid.op7_language_id,
    "op8_warc": warc.op8_warc,
    "op9_substring_dedup": repeats.op9_substring_dedup,
    "op10_impact_topk": topk.op10_impact_topk,
}
ORACLES: dict[str, str] = {"op3_mix_sources": mixing.ORACLE, "op6_line_dedup": lines.ORACLE, "op8_warc": warc.ORACLE}
