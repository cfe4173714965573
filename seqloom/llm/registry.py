"""The corpus queries and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from seqloom.llm import op8_exact
from seqloom.llm.op1_language import op1_language
from seqloom.llm.op2_jaccard import op2_jaccard
from seqloom.llm.op3_extract import op3_extract
from seqloom.llm.op4_mix import op4_mix
from seqloom.llm.op5_aq import op5_aq
from seqloom.llm.op6_tokens import op6_tokens
from seqloom.llm.op7_bpe import op7_bpe
from seqloom.llm.op9_toxicity import op9_toxicity
from seqloom.llm.op10_repeats import op10_repeats

QUERIES = {
    "op1_language": op1_language,
    "op2_jaccard": op2_jaccard,
    "op3_extract": op3_extract,
    "op4_mix": op4_mix,
    "op5_aq": op5_aq,
    "op6_tokens": op6_tokens,
    "op7_bpe": op7_bpe,
    "op8_exact": op8_exact.op8_exact,
    "op9_toxicity": op9_toxicity,
    "op10_repeats": op10_repeats,
}

ORACLE_SQL: dict[str, str] = {"op8_exact": op8_exact.SQL}
