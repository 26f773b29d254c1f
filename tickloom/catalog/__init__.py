"""All registered queries."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("ingest", "bars", "merging", "jobs")


def load_all():
    from .registry import QUERIES
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return QUERIES
