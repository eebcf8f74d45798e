"""Named queries over the driver's tables."""

from wordweave.plans import graph_queries, log_queries, stream_queries, text_queries
from wordweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "graph_queries", "log_queries", "stream_queries", "text_queries"]
