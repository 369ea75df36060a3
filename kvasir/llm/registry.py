"""The subpackage's queries and SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    "op1_token_output", "op2_packing", "op3_quality", "op4_topk", "op5_language",
    "op6_simhash", "op7_line_dedup", "op8_suffix_dedup", "op9_sentencepiece", "op10_license",
]


def _modules():
    return [importlib.import_module(f"kvasir.llm.{m}") for m in _MODULES]


def queries() -> dict:
    import corpus_pipeline

    out = {k: f for m in _modules() for k, f in m.QUERIES.items()}
    out["pipeline"] = corpus_pipeline.run
    return out


def sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: q for m in _modules() for k, q in m.SQL.items()}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
