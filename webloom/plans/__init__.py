"""Composed jobs and the registered queries with their SQL checks."""

from __future__ import annotations

import importlib

_MODULES = ("url_queries", "page_queries", "robots_queries", "sitemap_queries", "rule_queries", "frontier_queries", "stats_queries", "window_queries", "io_queries", "chat_queries", "stream_queries")


def all_queries():
    """Name to query, over all modules of registered queries."""
    for module in _MODULES:
        importlib.import_module(f"webloom.plans.{module}")
    from webloom.plans.catalog import REGISTRY

    return dict(REGISTRY)
