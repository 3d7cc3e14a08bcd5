"""Queries of this subpackage and the SQL that states the same where SQL can."""

from __future__ import annotations

from aeolia.llm.alignment import op13_alignment
from aeolia.llm.decontam import op3_decontam
from aeolia.llm.licences import OP10_SQL, op10_licences
from aeolia.llm.maxent import op5_maxent
from aeolia.llm.near import OP6_SQL, op6_near
from aeolia.llm.passages import op7_passages
from aeolia.llm.personal import op4_personal
from aeolia.llm.pieces import op9_pieces
from aeolia.llm.quality import op1_quality
from aeolia.llm.search import OP12_SQL, op12_search
from aeolia.llm.secrets import op8_secrets
from aeolia.llm.stretches import OP7_STRETCHES_SQL, op7_stretches
from aeolia.llm.toxicity import op2_toxicity
from aeolia.llm.url_rules import OP11_SQL, op11_urls
from aeolia.llm.units import OP7_ALL_SQL, op7_all_lines

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_decontam": op3_decontam,
    "op4_personal": op4_personal,
    "op5_maxent": op5_maxent,
    "op6_near": op6_near,
    "op7_stretches": op7_stretches,
    "op7_passages": op7_passages,
    "op7_all_lines": op7_all_lines,
    "op8_secrets": op8_secrets,
    "op9_pieces": op9_pieces,
    "op10_licences": op10_licences,
    "op11_urls": op11_urls,
    "op12_search": op12_search,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op6_near": OP6_SQL,
    "op7_stretches": OP7_STRETCHES_SQL,
    "op7_all_lines": OP7_ALL_SQL,
    "op10_licences": OP10_SQL,
    "op11_urls": OP11_SQL,
    "op12_search": OP12_SQL,
}
