"""Query registry: a name, the operators it covers, a plan, and its oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvergrain.plans.oracle import assemble
from silvergrain.session import tune
from silvergrain.sources.archive import Archive

PLANS: dict[str, Callable[[Archive], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, *covers: str, oracle: str | None = None):
    """Register a plan taking an :class:`Archive` under ``name``."""
    def wrap(plan: Callable[[Archive], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = oracle
        return plan
    return wrap


def oracles() -> dict[str, str]:
    """Complete oracle texts; assembled here, when all shared views have been named."""
    return {name: assemble(sql) for name, sql in ORACLES.items()}


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return plan(Archive(spark, sf_dir))
        return run
    return {name: bind(plan) for name, plan in PLANS.items()}
