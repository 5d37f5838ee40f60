"""Queries of the retrieval engine by name, and the SQL each is held against."""

from __future__ import annotations

from corpusloom.plans.queries import QUERIES
from corpusloom.plans.sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]
