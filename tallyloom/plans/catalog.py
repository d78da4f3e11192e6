"""All registered queries over the logical tables."""

from __future__ import annotations

from . import q_notes, q_reports, q_rows, q_sets, q_time  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = QUERIES["top_domains_per_category"]

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
