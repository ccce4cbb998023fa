"""Named queries over the driver's tables, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of plans; importing one registers them. They are imported when asked for, as the library below needs the dialect only.
MODULES = ("catalogue", "described", "frames", "loading", "ranked", "relational", "resolution", "scalars", "streams")


def _dialect():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.dialect")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _dialect().queries()


def oracle_sql() -> dict[str, str]:
    return _dialect().oracle_sql()
