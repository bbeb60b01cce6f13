"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from ledgerloom.plans import board, changes, compliance, corpus, discovery, doctypes, evaluation, graphs, items, layout, paged, payloads, perception, pricing, records, relational, requirements, streams, tender, validation
from ledgerloom.plans.base import ORACLES, QUERIES

MODULES = (relational, pricing, corpus, changes, board, graphs, streams, tender, validation, evaluation, doctypes, records, requirements, compliance, perception, discovery, items, layout, payloads, paged)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
