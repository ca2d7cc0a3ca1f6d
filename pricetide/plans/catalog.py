"""All registered queries."""

from pricetide.plans import alert_queries, model_queries, serving_queries, sync_queries, text_queries  # noqa: F401
from pricetide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
