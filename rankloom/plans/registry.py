"""Collects the registered queries of every family."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rankloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, key: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            if key in self.queries:
                raise ValueError(f"duplicate query key {key}")
            self.queries[key] = function
            if oracle is not None:
                self.oracles[key] = oracle
            return function

        return register


def _tuned(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(tune(spark), folder)

    return run


def full_catalog() -> Catalog:
    from rankloom.plans import FAMILIES

    whole = Catalog()
    for family in FAMILIES:
        for key, function in family.CATALOG.queries.items():
            whole.query(key, family.CATALOG.oracles.get(key))(_tuned(function))
    return whole
