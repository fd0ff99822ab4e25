"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("op1_language_id", "op2_pseudonyms", "op3_secrets", "op4_chunk_dedup", "op5_licenses", "op6_tiff", "op7_gru_lm", "op8_decontaminate", "op9_packing", "op10_ngram_join", "op11_resample", "op12_sharding", "op13_lexical_search")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"seqgraph.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
