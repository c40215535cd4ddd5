"""All queries of the core, with their SQL equivalents."""

from __future__ import annotations

from pilegrain.plans import actions, experiments, graphs, instants, library, reviews, samples, scores, streams, tuning

_MODULES = (library, scores, samples, graphs, reviews, tuning, actions, experiments, streams)
QUERIES = {"p4_found": instants.p4_found} | {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
