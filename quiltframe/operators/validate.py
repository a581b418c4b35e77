"""Checks on tables and requests, as rows (check, column, value, passed)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.functions.cells import col, count_if, is_missing

MAX_NULL_SHARE = 0.9
MIN_SAMPLE_ROWS = 2


class TableError(ValueError):
    """A table, sample or request that does not meet the requirements."""


def _check(name, column, value, passed):
    return F.struct(
        F.lit(name).alias("check"), F.lit(column).cast("string").alias("column"),
        value.cast("double").alias("value"), passed.alias("passed"))


def check_table(df: DataFrame) -> DataFrame:
    """Rows, columns, share of missing cells, infinite values: one aggregation."""
    names, n = df.columns, F.count(F.lit(1))
    missing = sum((count_if(is_missing(df, c)) for c in names), F.lit(0))
    share = F.when(n * len(names) > 0, missing / (n * F.lit(len(names))))
    checks = [
        _check("rows", None, n, n > 0),
        _check("columns", None, F.lit(len(names)), F.lit(len(names) > 0)),
        _check("null_share", None, share, F.coalesce(share <= MAX_NULL_SHARE, F.lit(False))),
    ]
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            infinite = count_if(F.abs(col(field.name)) == F.lit(float("inf")))
            checks.append(_check("infinite", field.name, infinite, infinite == 0))
    return df.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def check_sample(df: DataFrame) -> DataFrame:
    """At least two rows and one column; columns that are all missing are flagged."""
    n = F.count(F.lit(1))
    checks = [
        _check("rows", None, n, n >= MIN_SAMPLE_ROWS),
        _check("columns", None, F.lit(len(df.columns)), F.lit(len(df.columns) > 0)),
    ]
    for name in df.columns:
        filled = count_if(~is_missing(df, name))
        checks.append(_check("filled", name, filled, filled > 0))
    return df.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))


def _failures(checks: DataFrame) -> list:
    return checks.where(~F.col("passed")).collect()  # one row per check and column at most


def require_valid(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise TableError("the table has no column")
    failed = _failures(check_table(df))
    if failed:
        raise TableError("; ".join(f"{r['check']} {r['column'] or ''}={r['value']}" for r in failed))
    return df


def require_sample(df: DataFrame) -> list[str]:
    """Raise on a sample too small to model; return the columns that are all missing."""
    if df is None or not df.columns:
        raise TableError("a sample needs columns")
    failed = _failures(check_sample(df))
    if any(r["check"] != "filled" for r in failed):
        raise TableError(f"a sample of fewer than {MIN_SAMPLE_ROWS} rows cannot be modelled")
    return [r["column"] for r in failed]


def check_row_count(n: int) -> None:
    """Requests need at least one row; there is no upper limit."""
    if n is None or n < 1:
        raise TableError(f"cannot make {n} rows")


def widen_sample(df: DataFrame) -> DataFrame:
    """A one-row sample is used twice, so that it can be modelled at all."""
    return df.unionAll(df) if len(df.take(2)) < 2 else df
