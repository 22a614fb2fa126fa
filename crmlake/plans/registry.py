"""All registered queries: import order fixes the registry order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crmlake.plans import (registry_crm, registry_display, registry_edu,  # noqa: F401  (register)
                           registry_maintenance, registry_order, registry_stored)
from crmlake.plans.catalog import QUERIES, present
from crmlake.sources.bindings import Bindings


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return present(QUERIES[name].build(Bindings.of(spark, sf_dir)))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir, name)
        call.__name__ = name
        call.__doc__ = QUERIES[name].doc
        return call
    return {name: make(name) for name in QUERIES}


def oracles() -> dict[str, str]:
    return {name: q.oracle() for name, q in QUERIES.items() if q.sql is not None}
