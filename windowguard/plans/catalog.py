"""All queries, collected by importing the modules that register them."""

from windowguard.plans import (  # noqa: F401
    endpoint_queries,
    scoring_queries,
    service_queries,
    storage_queries,
    sweep_queries,
    text_queries,
    wide_queries,
)
from windowguard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
