"""Every operator as a named query over the given tables, with the SQL that must agree."""

from cedarlog.registry.base import ORACLE, QUERIES
from cedarlog.registry import chat, history, jobs, logs, parsing, retrieval, scoring, templates  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
