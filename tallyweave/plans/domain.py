"""The derived views themselves, as queries: what all other plans read."""

from __future__ import annotations

from tallyweave.plans.fixtures import CTES
from tallyweave.plans.registry import query

for _name in CTES:
    query(f"SELECT * FROM {_name}", name=f"view_{_name}")(lambda v, n=_name: getattr(v, n))
