"""Named queries over the given tables."""

from __future__ import annotations

import importlib

from lintlake.catalog.core import ORACLES, QUERIES

MODULES = ("rules", "structure", "ingest", "triage", "metrics", "context", "streams", "scans")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lintlake.catalog.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
