"""Queries of the training-data operators, one for each, over whole tables. Exact duplicates have SQL; no engine without user
code expresses the others, so tests hold them against brute force."""

from __future__ import annotations

from genolake.llm.bpe import op7_bpe
from genolake.llm.exact import OP12_SQL, op12_exact_dedup
from genolake.llm.language import op1_language
from genolake.llm.lm import op2_lm
from genolake.llm.packing import op3_packing
from genolake.llm.pii import op6_pii
from genolake.llm.piecewise import op9_piecewise
from genolake.llm.quality import op10_quality
from genolake.llm.resampling import op13_resampling
from genolake.llm.simhash import op5_simhash
from genolake.llm.toxicity import op8_toxicity
from genolake.llm.variants import op11_variants
from genolake.llm.vectors import op4_vectors

QUERIES = {
    "op1_language": op1_language,
    "op2_lm": op2_lm,
    "op3_packing": op3_packing,
    "op4_vectors": op4_vectors,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_piecewise": op9_piecewise,
    "op10_quality": op10_quality,
    "op11_variants": op11_variants,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL: dict[str, str] = {"op12_exact_dedup": OP12_SQL}
