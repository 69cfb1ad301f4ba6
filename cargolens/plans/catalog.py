"""All registered queries and the SQL that states their results."""

from __future__ import annotations

import importlib

from .reconciling import flagship  # noqa: F401

AREAS = ["normalizing", "reconciling", "intake", "stores"]


def _all(name: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out |= getattr(importlib.import_module(f"{__package__}.{area}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
