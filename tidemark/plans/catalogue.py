"""All registered queries of the reference's own operators."""

from __future__ import annotations

from . import actions, aggregates, calendars, evaluating, geometry, library, linking, reading, records, relational, searching, streams, texts, timing, trialling, views  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
