"""All registered queries."""

from logharbor.plans import (  # noqa: F401
    ingest_queries,
    metric_queries,
    rootcause_queries,
    stream_queries,
    table_queries,
    vector_queries,
)
from logharbor.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
