"""Registered queries with their SQL oracles."""

from __future__ import annotations

import importlib

from lotwise.queries.base import ORACLES, QUERIES

for _part in ("q_text", "q_numbers", "q_lookup", "q_extract", "q_dedupe", "q_state", "q_ordered", "q_report", "q_files"):
    importlib.import_module(f"lotwise.queries.{_part}")

__all__ = ["ORACLES", "QUERIES"]
