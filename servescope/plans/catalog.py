"""All registered queries in one place."""

from __future__ import annotations

import importlib

AREAS = ("metrics", "integrity", "quality", "comparison", "telemetry", "replay", "evidence", "streams")

QUERIES: dict = {}
ORACLES: dict = {}
for _area in AREAS:
    _module = importlib.import_module(f"servescope.plans.{_area}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
