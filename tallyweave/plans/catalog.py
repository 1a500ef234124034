"""The registered queries of the reconciliation engine and the SQL that each is held against."""

from __future__ import annotations

from tallyweave.plans import details, domain, matching, reports, streams, updates  # noqa: F401
from tallyweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
