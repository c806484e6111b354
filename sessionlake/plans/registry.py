"""All registered queries and their DuckDB equivalents."""

from . import broker_plans, calendar_plans, event_plans, quote_plans, source_plans, text_plans, watch_plans  # noqa: F401 - they register
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
