"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tillwork.llm import conversation_sql, repeats_sql
from tillwork.llm.conversation_repair import op13_conversation_repair
from tillwork.llm.decontamination import op8_decontamination
from tillwork.llm.fuzzy_lines import op9_fuzzy_lines
from tillwork.llm.kd_shards import op2_kd_shards
from tillwork.llm.language_id import op11_language_id
from tillwork.llm.mixing import op6_mixing
from tillwork.llm.near_dup import op7_near_dup
from tillwork.llm.personal_data import op10_personal_data
from tillwork.llm.quality_rules import op4_quality_rules
from tillwork.llm.suffix_dedup import op3_suffix_dedup
from tillwork.llm.suffix_tree_lm import op1_suffix_tree_lm
from tillwork.llm.whitening import op12_feast_whitening
from tillwork.llm.window_dedup import op5_window_dedup

QUERIES = {
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op2_kd_shards": op2_kd_shards,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_window_dedup": op5_window_dedup,
    "op6_mixing": op6_mixing,
    "op7_near_dup": op7_near_dup,
    "op8_decontamination": op8_decontamination,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_personal_data": op10_personal_data,
    "op11_language_id": op11_language_id,
    "op12_feast_whitening": op12_feast_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op3_suffix_dedup": repeats_sql.BYTES,
    "op5_window_dedup": repeats_sql.WINDOWS,
    "op7_near_dup": repeats_sql.NEAR,
    "op13_conversation_repair": conversation_sql.SQL,
}
