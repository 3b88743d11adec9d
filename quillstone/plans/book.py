"""A book of queries: each page pairs a plan with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.fixtures import oracle, view
from quillstone.sources.shared import importable


class Views:
    """v('name') is a view of one sf_dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def page(self, name: str, views: str = "", sql: str | None = None):
        """Registers a plan: a function of Views. sql is its oracle over the named views."""

        def add(plan: Callable[[Views], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: plan(Views(importable(spark), sf_dir))
            if sql:
                self.oracle[name] = oracle(views, sql)
            return plan

        return add
