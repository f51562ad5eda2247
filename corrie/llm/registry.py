"""Driver queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html_extract, jaccard, kdtree, langid, lm_score, mixing, pii, suffix_dedup, toxicity

QUERIES = {
    "op1_top_k": kdtree.op1_top_k,
    "op2_langid": langid.op2_langid,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_html": html_extract.op6_html,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_pii": pii.op9_pii,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op1_top_k": kdtree.OP1_SQL,
    "op5_jaccard": jaccard.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
