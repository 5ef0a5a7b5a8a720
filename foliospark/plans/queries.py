"""The queries of the core, by name."""

from __future__ import annotations

import importlib
import importlib.util

from .registry import ORACLES, QUERIES, Query

MODULES = ("text_queries", "table_queries", "layout_queries", "extract_queries", "structure_queries", "helper_queries", "page_queries", "file_queries")


def _load() -> None:
    for m in MODULES:
        if importlib.util.find_spec(f"{__package__}.{m}"):
            importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
