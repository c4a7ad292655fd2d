"""Query catalogue. Importing it registers every query."""

from lanespan.plans import audit_queries, mask_queries, metric_queries, temporal_queries  # noqa: F401
from lanespan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
