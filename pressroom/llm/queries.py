"""The registered queries of this subpackage: name -> (query, its SQL or None)."""

from __future__ import annotations

import corpus_pipeline
from pressroom.llm import bytededup, convrepair, decontam, hardneg, htmlcrf, jaccard, langid, neardup_vec, packing, patternpack, sharding, substring, toxicity

LLM_REGISTRY = {
    "op1_substring_dedup": (substring.q_op1_substring_dedup, substring.sql_op1),
    "op2_toxicity": (toxicity.q_op2_toxicity, None),
    "op3_decontaminate": (decontam.q_op3_decontaminate, decontam.sql_op3),
    "op10_language": (langid.q_op10_language, None),
    "op8_main_text": (htmlcrf.q_op8_main_text, None),
    "op9_pack": (packing.q_op9_pack, None),
    "op4_ngram_join": (jaccard.q_op4_ngram_join, jaccard.sql_op4),
    "op5_near_vectors": (neardup_vec.q_op5_near_vectors, neardup_vec.sql_op5),
    "op6_suffix_dedup": (bytededup.q_op6_suffix_dedup, bytededup.sql_op6),
    "pipeline": (corpus_pipeline.run, None),
    "op7_interleave": (sharding.q_op7_interleave, sharding.sql_op7),
    "op12_conversation_repair": (convrepair.q_op12_conversation_repair, convrepair.sql_op12),
    "op13_hard_negatives": (hardneg.q_op13_hard_negatives, hardneg.sql_op13),
    "op11_pattern_pack": (patternpack.q_op11_pattern_pack, None),
}
