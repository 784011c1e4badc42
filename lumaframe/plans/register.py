"""Queries by name with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def component(v: Column) -> Column:
    """A vector's component in -127..127. It is multiplied as a float, as the SQL does; by an integer Spark multiplies doubles, and a product that rounds up to a whole number stays below it."""
    return F.floor(v * F.lit(127.0).cast("float"))


class Register:
    """Functions of pruned tables under their own names."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str, **tables: list[str]):
        """Register a function of the tables, each with the columns given, in order; pruning happens before anything else."""

        def keep(f: Callable[..., DataFrame]) -> Callable:
            self.queries[f.__name__] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*columns) for t, columns in tables.items()])
            self.sql[f.__name__] = sql
            return f

        return keep
