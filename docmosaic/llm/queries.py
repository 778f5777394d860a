"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from docmosaic.llm.base import ORACLES, QUERIES  # noqa: F401

for _name in ("q_text", "q_filters", "q_joins", "q_search"):
    import_module(f"docmosaic.llm.{_name}")
