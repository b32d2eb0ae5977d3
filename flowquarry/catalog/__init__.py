"""Registered queries over the shared tables."""

import importlib

from flowquarry.catalog.book import CHECKS, QUERIES

for _module in ("packet_queries", "table_queries", "model_queries", "more_queries"):
    importlib.import_module(f"flowquarry.catalog.{_module}")

__all__ = ["CHECKS", "QUERIES"]
