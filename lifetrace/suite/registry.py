"""All registered queries, in the order of the operator inventory."""

from __future__ import annotations

import importlib

MODULES = (
    "scans", "construction", "predicates", "joins", "aggregates", "positions", "pages",
    "tags", "timelines", "lineage", "annotations", "streams", "questions",
)

QUERIES: dict = {}
ORACLES: dict = {}

for _name in MODULES:
    try:
        _module = importlib.import_module(f"lifetrace.suite.{_name}")
    except ModuleNotFoundError as exc:
        if exc.name != f"lifetrace.suite.{_name}":
            raise
        continue
    for _key, (_fn, _sql) in _module.ENTRIES.items():
        QUERIES[_key] = _fn
        if _sql is not None:
            ORACLES[_key] = _sql
