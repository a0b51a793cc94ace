"""All registered queries over the driver's tables."""

from . import q_extras, q_facts, q_features, q_more, q_retrieval, q_rows, q_stats, q_streams, q_text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
