"""All registered queries."""

from __future__ import annotations

from lodestone.plans import extraction, findings, flows, graphs, relations, search, structure
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extraction", "findings", "flows", "graphs", "relations", "search", "structure"]
