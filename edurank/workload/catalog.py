"""All registered queries."""

from edurank.workload import analytics_queries, branch_queries, change_queries, file_queries, ingest_queries, partition_queries, quality_queries, run_queries  # noqa: F401
from edurank.workload.registry import REGISTRY, run

__all__ = ["REGISTRY", "run"]
