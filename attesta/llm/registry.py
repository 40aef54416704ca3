"""Queries of this package and their SQL."""
from __future__ import annotations

from attesta.llm.chat import OP4_SQL, op4_chat
from attesta.llm.decontamination import op10_decontamination
from attesta.llm.html_extraction import op7_html
from attesta.llm.licenses import OP1_SQL, op1_licenses
from attesta.llm.mixing import op8_mixing
from attesta.llm.passages import op9_passages
from attesta.llm.quality import op2_quality
from attesta.llm.secrets import op5_secrets
from attesta.llm.sharding import op6_sharding
from attesta.llm.simhash import op3_simhash
from attesta.llm.suffixes import op12_suffixes
from attesta.llm.term_pipeline import OP11_SQL, op11_search
from attesta.llm.turn_repair import op13_turns

QUERIES = {"op1_licenses": op1_licenses, "op2_quality": op2_quality, "op3_simhash": op3_simhash, "op4_chat": op4_chat, "op5_secrets": op5_secrets,
           "op6_sharding": op6_sharding, "op7_html": op7_html, "op8_mixing": op8_mixing, "op9_passages": op9_passages, "op10_decontamination": op10_decontamination,
           "op11_search": op11_search, "op12_suffixes": op12_suffixes,
           "op13_turns": op13_turns}
ORACLE = {"op1_licenses": OP1_SQL, "op4_chat": OP4_SQL, "op11_search": OP11_SQL}
