"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from flowframe.llm.chat import op3_chat_format
from flowframe.llm.decontamination import op5_benchmark_decontamination
from flowframe.llm.mil_quality import op10_quality_classifier
from flowframe.llm.oracle import ORACLE_SQL
from flowframe.llm.packing import op6_best_fit_packing
from flowframe.llm.quality_rules import op7_quality_rules
from flowframe.llm.simhash import op9_simhash_near_dedup
from flowframe.llm.substring_dedup import op4_substring_dedup
from flowframe.llm.token_counts import op8_token_counts
from flowframe.llm.token_store import op2_token_store
from flowframe.llm.url_filter import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_token_store,
        op3_chat_format,
        op4_substring_dedup,
        op5_benchmark_decontamination,
        op6_best_fit_packing,
        op7_quality_rules,
        op8_token_counts,
        op9_simhash_near_dedup,
        op10_quality_classifier,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
