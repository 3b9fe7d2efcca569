"""All registered queries."""

from . import q_series, q_summary, q_time, q_tree  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
