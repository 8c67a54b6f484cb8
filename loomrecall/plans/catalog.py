"""All registered queries outside the llm subpackage, with their SQL."""

from loomrecall.plans import graph, index, reports, search, sessions, store, texts  # noqa: F401
from loomrecall.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
