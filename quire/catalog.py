"""Every query of the reference's operators with its DuckDB twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.ship import ship

MODULES = ("operators.guards", "operators.profile", "operators.grid", "functions.tensor", "functions.solver", "operators.images", "operators.raster", "operators.networks", "functions.content", "functions.vector", "plans.ladder", "streaming.pages", "sources.files", "sources.snapshots")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load_all()
    return ORACLES


def load_all() -> None:
    """Import the modules whose queries register themselves; not when this module is imported, as they import it."""
    for m in MODULES:
        importlib.import_module(f"quire.{m}")
