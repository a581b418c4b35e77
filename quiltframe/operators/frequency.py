"""Value frequencies of many columns in one shuffle.

Counting values first and aggregating the counts afterwards keeps every later
statistic (distinct count, mode, entropy, vocabulary) free of per-value state
in one task: a value that fills a third of the table is already one row per
map task before anything is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.functions.cells import col, flat_columns, is_text, present
from quiltframe.operators.scratch import settle

LONG_TEXT = 64
HEAD = 16       # characters of a text that travel with its digest
FEW = 1000      # texts that are compared whole, in the tasks that hold them


def value_counts(df: DataFrame, names: list[str] | None = None, *,
                 label=None, digest_long: bool = False) -> DataFrame:
    """(column, value, n) over the non-missing cells of the named columns.

    Values are compared as text. `label` maps a text Column before counting.
    `digest_long` replaces text over 64 characters by its SHA-256 digest, for
    callers that only count distinct values: long texts then never travel.
    """
    names = flat_columns(df) if names is None else names

    def cell(name: str) -> Column:
        kind = df.schema[name].dataType
        # Clock changes repeat an hour of text.
        text = F.unix_micros(col(name)).cast("string") if digest_long and isinstance(kind, T.TimestampType) \
            else _plain_text(df, name)
        if label is not None:
            text = label(text)
        if digest_long and is_text(kind):
            text = F.when(F.length(text) <= LONG_TEXT, text).otherwise(F.sha2(text, 256))
        return text.alias(name)

    return _unpivoted(df.select(*[cell(n) for n in names]), names).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def _unpivoted(wide: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) of the cells that are not NULL."""
    if len(names) == 1:
        cells = wide.select(F.lit(names[0]).alias("column"), col(names[0]).alias("value"))
    else:
        cells = wide.unpivot([], [col(n) for n in names], "column", "value")
    return cells.where(F.col("value").isNotNull())


def most_common_values(df: DataFrame, names: list[str]) -> dict[str, tuple[int, str | None]]:
    """column -> (distinct values, the most frequent value as text, the lowest on ties).

    Long texts are counted by digest. Of a text only HEAD characters travel, to settle
    ties: of the most frequent texts those with the lowest head stay. When few are left,
    the tasks that hold them compare them whole and pass on one each; while many are
    (texts with one beginning), the next HEAD characters decide among the rows that
    begin as the best ones do.
    """
    texts = {n: _plain_text(df, n) for n in names}
    out: dict[str, tuple[int, str | None]] = {n: (0, None) for n in names}
    begins = {n: "" for n in names}
    while begins:
        cells = _unpivoted(df.select(*[F.when(F.startswith(texts[n], F.lit(b)), texts[n]).alias(n)
                                       for n, b in begins.items()]), list(begins))
        skip = max(len(b) for b in begins.values())
        mark = F.when(F.length("value") <= LONG_TEXT, F.concat(F.lit("t"), "value")).otherwise(F.sha2("value", 256))
        counts = settle(cells.groupBy("column", mark.alias("mark"), F.substring("value", skip + 1, HEAD).alias("head"))
                        .agg(F.count(F.lit(1)).alias("n")))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("head").alias("head"))).alias("best")
        per_column = counts.groupBy("column").agg(best, F.count(F.lit(1)).alias("distinct"))
        first = counts.join(F.broadcast(per_column), "column").where(  # one row per column
            (F.col("n") == -F.col("best.n")) & (F.col("head") == F.col("best.head")))
        left = first.groupBy("column").agg(F.first("head").alias("head"), F.first("distinct").alias("distinct"),
                                           F.count(F.lit(1)).alias("n")).collect()
        few = [r["column"] for r in left if r["n"] <= FEW]
        marks = first.where(F.col("column").isin(few)).select("column", "mark").collect() if few else []
        found = _lowest(cells, mark, few, marks)
        following = {}
        for r in left:
            name = r["column"]
            if not begins[name]:
                out[name] = r["distinct"], None
            if name in few:
                out[name] = out[name][0], found[name]
            else:
                following[name] = begins[name] + r["head"]
        begins = following
    return out


def _lowest(cells: DataFrame, mark: Column, names: list[str], marks: list) -> dict[str, str]:
    """The lowest of the marked texts of every column; each task passes on one."""
    if not names:
        return {}
    wanted = cells.sparkSession.createDataFrame([(r["column"], r["mark"]) for r in marks], "column string, mark string")
    held = cells.withColumn("mark", mark).join(F.broadcast(wanted), ["column", "mark"])  # FEW per column
    return {r["column"]: r["v"] for r in held.groupBy("column").agg(F.min("value").alias("v")).collect()}


def _plain_text(df: DataFrame, name: str) -> Column:
    """A present cell as text; -0.0 is 0.0."""
    value, kind = present(df, name), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(kind)
    return value.cast("string")


def entropy() -> Column:
    """Aggregate over (value, n): natural-log entropy, ln N - sum(n ln n) / N."""
    total = F.sum("n").cast("double")
    return F.ln(total) - F.sum(F.col("n") * F.ln(F.col("n").cast("double"))) / total


def distinct_counts(freq: DataFrame) -> DataFrame:
    return freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values"))


def in_column_order(stats: DataFrame, names: list[str]) -> DataFrame:
    """Left-join per-column results to the full list of columns, so none is lost."""
    spark = stats.sparkSession
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)],
                                  "column string, position int")
    # One row per column on both sides: bounded by the width of the table.
    return order.join(F.broadcast(stats), "column", "left")
