"""All registered queries."""

from mediasift.plans import (  # noqa: F401
    assess_queries,
    file_queries,
    lifecycle_queries,
    result_queries,
    stream_queries,
)
from mediasift.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
