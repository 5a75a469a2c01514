"""Registry helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urbanflow.fixtures import view, with_views
from urbanflow.model import Network


class Area:
    """Collects the queries of a module, with the SQL that checks each."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
        """``sql`` continues the WITH clause of the views: it starts with SELECT, or with a comma and more CTEs."""

        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = f"{with_views(*views, recursive=recursive)}\n{sql}" if views else sql
            return f

        return add


def streets(spark: SparkSession, sf_dir: str) -> Network:
    return Network(view(spark, sf_dir, "fx_nodes"), view(spark, sf_dir, "fx_edges"), "EPSG:32630")


def forest(spark: SparkSession, sf_dir: str) -> Network:
    return Network(view(spark, sf_dir, "fx_nodes"), view(spark, sf_dir, "fx_forest"), "EPSG:32630")
