"""All queries of the llm subpackage, with their SQL equivalents."""

from __future__ import annotations

from pilegrain.llm import queries_caps, queries_consolidate, queries_encode, queries_mixing, queries_personal, queries_piles, queries_quota, queries_splits, queries_stable

_MODULES = (queries_piles, queries_splits, queries_quota, queries_consolidate, queries_stable, queries_caps, queries_encode, queries_mixing, queries_personal)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
