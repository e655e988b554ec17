"""All registered queries: importing their modules fills the registry."""

from __future__ import annotations

from pulseframe.plans import case_queries, queries, report_queries, sheet_queries  # noqa: F401
from pulseframe.plans.registry import QUERIES, SQL  # noqa: F401
