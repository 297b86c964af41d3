"""All registered queries. Importing a section registers its queries."""
from __future__ import annotations

from . import bars_and_panel, books_and_signals, evaluation, events_and_ledger, ingestion, relational, streams  # noqa: F401
from .registry import ORACLES, QUERIES

flagship = bars_and_panel.flagship

__all__ = ["QUERIES", "ORACLES", "flagship"]
