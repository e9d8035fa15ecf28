"""Everything that is registered."""

from __future__ import annotations

from . import job_queries, layout_queries, library_queries, package_queries, segment_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
