"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe_count import op6_token_counts
from .bpe_prefix import op8_prefix_bpe
from .fm_dedup import SQL as OP7_SQL
from .fm_dedup import op7_substring_dedup
from .packing import op9_packing
from .quality_bt import op1_bradley_terry
from .quality_rules import op10_quality_rules
from .simple8b import op2_simple8b
from .simhash_vptree import op3_simhash
from .topk_bond import SQL as OP4_SQL
from .topk_bond import op4_top_k
from .toxicity_gbt import op5_toxicity

QUERIES = {
    "op1_bradley_terry": op1_bradley_terry,
    "op2_simple8b": op2_simple8b,
    "op3_simhash": op3_simhash,
    "op4_top_k": op4_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_prefix_bpe": op8_prefix_bpe,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {"op4_top_k": OP4_SQL, "op7_substring_dedup": OP7_SQL}
