"""All queries of the reference's operators; importing a module registers its own."""

from __future__ import annotations

from quern.plans import annotations, documents, engine, pages, planning, reports, streams  # noqa: F401
from quern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
