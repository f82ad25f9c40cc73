"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from mediaflow.llm.bpe import op1_bpe
from mediaflow.llm.chat import OP3_SQL, op3_chat
from mediaflow.llm.exact_dedup import OP13_SQL, op13_perfect_hash
from mediaflow.llm.fim import OP12_SQL, op12_fim
from mediaflow.llm.line_dedup import op7_line_dedup
from mediaflow.llm.lm_scoring import op10_context_mixing
from mediaflow.llm.minhash import OP4_SQL, op4_minhash
from mediaflow.llm.packing import op2_packing
from mediaflow.llm.quality_classifier import op5_quality_pu
from mediaflow.llm.quality_rules import OP6_SQL, op6_quality_rules
from mediaflow.llm.spotsigs import OP8_SQL, op8_spotsigs
from mediaflow.llm.token_alignment import op11_space_anchors
from mediaflow.llm.toxicity import op9_toxicity

QUERIES = {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_chat": op3_chat, "op4_minhash": op4_minhash, "op5_quality_pu": op5_quality_pu, "op6_quality_rules": op6_quality_rules, "op7_line_dedup": op7_line_dedup, "op8_spotsigs": op8_spotsigs, "op9_toxicity": op9_toxicity, "op10_context_mixing": op10_context_mixing, "op11_space_anchors": op11_space_anchors, "op12_fim": op12_fim, "op13_perfect_hash": op13_perfect_hash}
ORACLE_SQL = {"op3_chat": OP3_SQL, "op4_minhash": OP4_SQL, "op6_quality_rules": OP6_SQL, "op8_spotsigs": OP8_SQL, "op12_fim": OP12_SQL, "op13_perfect_hash": OP13_SQL}
