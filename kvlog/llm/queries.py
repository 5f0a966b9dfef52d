"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from kvlog.llm.decontaminate import OP2_SQL, op2_decontaminate
from kvlog.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from kvlog.llm.jaccard import OP7_SQL, op7_jaccard
from kvlog.llm.licenses import op4_licenses
from kvlog.llm.line_dedup import OP10_SQL, op10_line_dedup
from kvlog.llm.packing import op8_packing
from kvlog.llm.quality import op3_quality
from kvlog.llm.sharding import op1_sharding, op1_sql
from kvlog.llm.toxicity import op6_toxicity
from kvlog.llm.warc import OP5_SQL, op5_warc

QUERIES: dict = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard": op7_jaccard,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
}

#: op3 and op6 have no SQL (trained models): held-out accuracy is tested.
#: op4 has none either (labels of its own): its base columns are tested against brute force.
#: op8 has no SQL (a tokenizer and a dynamic program): see tests/llm/test_operators.py.
ORACLE_SQL: dict = {"op1_sharding": op1_sql(), "op2_decontaminate": OP2_SQL, "op5_warc": OP5_SQL, "op7_jaccard": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL}
