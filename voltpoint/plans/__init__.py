"""Registered queries, their SQL counterparts and the interactive workspace."""

from voltpoint.plans.oracle import oracle_sql
from voltpoint.plans.queries import entry, queries
from voltpoint.plans.workspace import Workspace

__all__ = ["Workspace", "entry", "oracle_sql", "queries"]
