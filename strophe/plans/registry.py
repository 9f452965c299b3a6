"""Where query modules register their queries and the SQL to check them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strophe.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables as a query, with its SQL if SQL can say it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[key] = sql
        return f

    return add
