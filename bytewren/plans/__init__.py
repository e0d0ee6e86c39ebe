"""Named queries over the test tables, one for each operator."""

from bytewren.plans import bytes_queries, context_queries, fold_queries, telemetry_queries, vector_queries  # noqa: F401
from bytewren.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
