"""Registration of runnable queries next to the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hectara.plans import testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Given and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return testbed.table(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return testbed.raw(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            testbed.ORACLE_TEXT[name] = sql
            ORACLES[name] = testbed.oracle(sql)
        return fn

    return register
