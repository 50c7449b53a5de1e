"""All queries of the engine by name, and their DuckDB statements."""

from . import eval_queries, extra_queries, more_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
