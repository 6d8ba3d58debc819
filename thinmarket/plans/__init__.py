"""Queries bound to the provided tables, each next to its SQL oracle."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("prices", "indicators", "sales", "screener", "market", "catalogue", "quality", "backtests", "desk", "ingest", "streams")


def load_all() -> None:
    for group in GROUPS:
        import_module(f"thinmarket.plans.{group}")


# A query's SQL takes the views that are there when it is registered, so their order is the same whichever module is asked for first.
load_all()
