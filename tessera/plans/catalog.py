"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from . import q_feeds, q_payloads, q_pipelines, q_rank, q_state, q_text  # noqa: F401  (they register)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
