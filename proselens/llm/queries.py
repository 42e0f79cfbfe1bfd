"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from proselens.llm.decontaminate import OP7_SQL, op7_benchmark_decontamination
from proselens.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from proselens.llm.html_text import op9_html_extraction
from proselens.llm.line_dedup import OP8_SQL, op8_line_dedup
from proselens.llm.lm_score import op1_lm_scoring
from proselens.llm.resample import op6_importance_resampling
from proselens.llm.simhash import op5_simhash_near_dedup
from proselens.llm.subwords import op3_sentencepiece_sampling
from proselens.llm.toxicity import op2_toxicity
from proselens.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece_sampling": op3_sentencepiece_sampling,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc": op10_warc,
}

ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_warc": OP10_SQL,
}
