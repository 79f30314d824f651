"""Registration of a query over the model's views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from codequarry.functions.rules import SCHEMA, Rules, default_rules
from codequarry.registry import query
from codequarry.sources.adapters import Model, with_views


def add(name: str, f: Callable[[Model], DataFrame], sql: str | None = None) -> None:
    query(name, with_views(sql) if sql else None)(lambda spark, sf_dir: f(Model(spark, sf_dir)))


def rules(m: Model) -> Rules:
    """COBOL's rules, as a configuration would give them."""
    return Rules(m.spark.createDataFrame(default_rules(), SCHEMA))
