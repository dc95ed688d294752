"""The registered queries of the core, by family."""

from __future__ import annotations

import importlib

FAMILIES = ("text_queries", "lookup_queries", "vote_queries", "set_queries", "score_queries", "layout_queries", "reading_queries", "engine_queries", "table_queries")


def load() -> None:
    """Imports every family, which registers its queries."""
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}")
