"""Named queries (Spark plans) with their DuckDB oracle statements."""

from __future__ import annotations

import importlib

from .registry import QUERIES, Query

_MODULES = [
    "taxonomy_queries",
    "metric_queries",
    "annotation_queries",
    "infobox_queries",
    "triple_queries",
    "split_queries",
    "prompt_queries",
    "resume_queries",
    "io_queries",
    "accounting_queries",
]


def load_all() -> dict[str, Query]:
    for mod in _MODULES:
        importlib.import_module(f"{__name__}.{mod}")
    return QUERIES
