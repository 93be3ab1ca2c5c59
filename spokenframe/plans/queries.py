"""All registered queries."""

from . import range_queries, selection_queries, signal_queries, stage_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
