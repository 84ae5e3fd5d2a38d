"""Importing this module registers every core query."""

from quire.plans import document_queries, field_queries, name_queries, nested_queries, relational_queries, report_queries, sequential_queries, text_queries  # noqa: F401
from quire.plans.registry import CORE

__all__ = ["CORE"]
