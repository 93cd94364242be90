"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quire.llm.audit import OP12_SQL, op12_filter_audit
from quire.llm.decontaminate import OP13_SQL, op13_decontamination
from quire.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from quire.llm.jaccard import OP8_SQL, op8_jaccard
from quire.llm.mixing import op3_mixing
from quire.llm.packing import op9_packing
from quire.llm.pii import op4_pii
from quire.llm.quality_rules import op10_quality_rules
from quire.llm.suffix import OP6_SQL, op6_suffix
from quire.llm.token_counts import op2_token_counts
from quire.llm.topk import OP5_SQL, op5_topk
from quire.llm.warc import OP7_SQL, op7_warc
from quire.llm.weak_labels import op1_weak_labels

QUERIES = {
    "op1_weak_labels": op1_weak_labels,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_suffix": op6_suffix,
    "op7_warc": op7_warc,
    "op8_jaccard": op8_jaccard,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontamination": op13_decontamination,
}

ORACLE: dict[str, str] = {
    "op5_topk": OP5_SQL,
    "op6_suffix": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_jaccard": OP8_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
