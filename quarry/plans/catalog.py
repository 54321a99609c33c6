"""All registered queries."""

from . import q_analytics, q_client, q_entities, q_office, q_sources, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
