"""The registry of queries and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.functions.cells import col

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register fn(tables) under its name, with the SQL giving the same rows."""
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded: sums depend on the order of addition."""
    return df.withColumns({
        f.name: F.round(col(f.name), places) for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def r(sql: str, places: int = 4) -> str:
    return f"(round({sql}, {places}) + 0e0)"


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)
