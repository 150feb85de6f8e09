"""The queries of this package and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .chat import OP12_SQL, op12_chat_format
from .filter_audit import OP13_SQL, op13_filter_audit
from .line_dedup import OP8_SQL, op8_line_dedup
from .near_duplicates import OP10_SQL, op10_minhash
from .packing import op3_packing
from .pii import OP7_SQL, op7_pii
from .quality import ABLATIONS_SQL, OP9_SQL, op9_quality_rules, quality_ablations
from .sharding import OP1_SQL, op1_sharding
from .token_counts import op5_token_counts
from .topk import OP6_SQL, op6_top_k
from .toxicity import op2_toxicity
from .variants import OP11_SQL, op11_spelling_variants

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_top_k": op6_top_k,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash": op10_minhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_chat_format": op12_chat_format,
    "op13_filter_audit": op13_filter_audit,
    "quality_ablations": quality_ablations,
}
ORACLES = {
    "op1_sharding": OP1_SQL,
    "op6_top_k": OP6_SQL,
    "op7_pii": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_minhash": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
    "quality_ablations": ABLATIONS_SQL,
}
