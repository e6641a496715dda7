"""All queries of this package but those of the corpus operators."""

from __future__ import annotations

from visgauge.plans import answers, boxes, choices, extras, metrics, protocol  # noqa: F401  each registers its queries
from visgauge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
