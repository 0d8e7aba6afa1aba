"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from scholion.llm import op1_packing as op1
from scholion.llm import op2_counts as op2
from scholion.llm import op3_scoring as op3
from scholion.llm import op4_exact_dedup as op4
from scholion.llm import op5_language as op5
from scholion.llm import op6_mixing as op6
from scholion.llm import op7_minhash as op7
from scholion.llm import op8_media as op8
from scholion.llm import op9_chat as op9
from scholion.llm import op10_licenses as op10
from scholion.llm import op11_search as op11
from scholion.llm import op12_periods as op12
from scholion.llm import op13_quality as op13


def queries() -> dict:
    return {
        "op1_packing": op1.op1_packing,
        "op2_counts": op2.op2_counts,
        "op3_scoring": op3.op3_scoring,
        "op4_exact_dedup": op4.op4_exact_dedup,
        "op5_language": op5.op5_language,
        "op6_mixing": op6.op6_mixing,
        "op7_minhash": op7.op7_minhash,
        "op8_media": op8.op8_media,
        "op9_chat": op9.op9_chat,
        "op10_licenses": op10.op10_licenses,
        "op11_search": op11.op11_search,
        "op12_periods": op12.op12_periods,
        "op13_quality": op13.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": op4.ORACLE, "op9_chat": op9.ORACLE}
