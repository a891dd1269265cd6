"""All registered queries."""

from launchlake.plans import counter_queries, dataset_queries, kernel_queries, launch_queries, metric_queries, ml_queries, stream_queries  # noqa: F401
from launchlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
