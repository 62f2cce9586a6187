"""All queries of this subpackage and their SQL, collected by importing what registers them."""

from windowguard.llm import queries  # noqa: F401
from windowguard.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
