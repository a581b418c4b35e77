"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.cells import col, flat_columns

SMALL_TABLE = 4_000_000
MIN_SHARES = 64


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str,
                sizes: DataFrame | None = None, at_most: int | None = None,
                repeated: bool = False) -> DataFrame:
    """Inner join of many rows to a table with one row, or a few rows, per key.

    `per_key[weight]` tells how many of `rows` have the key. The rows are thought
    of in equal shares, one per shuffle partition; a key larger than a share is
    split into as many parts as it fills shares, and its row in `per_key` copied
    for each part. There are fewer such keys than shares, and fewer than twice as
    many copies, so only those keys are broadcast and little is copied.

    The part of a row is a hash of its cells. If the rows of one key can be equal,
    `repeated` counts the rows of large keys first and deals the copies of a row
    over all parts (-0.0 then counts as 0.0).

    Keys must not be NULL. `sizes` holds one row per key where `per_key` has
    several. `at_most` is a bound on the number of rows, if one is known: a small
    one saves the pass that weighs the keys.
    """
    plain = per_key.drop(weight)
    if at_most is not None and at_most <= SMALL_TABLE:
        return rows.join(plain, keys, "inner")
    weighed = per_key if sizes is None else sizes
    total, top = weighed.agg(F.sum(weight), F.max(weight)).first()
    shares = max(MIN_SHARES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not total or total <= SMALL_TABLE or top * shares <= total:
        return rows.join(plain, keys, "inner")
    share = total / shares
    large = F.broadcast(weighed.where(col(weight) > share).select(
        *[col(k) for k in keys], F.ceil(col(weight) / F.lit(share)).alias("_parts")))
    split = _dealt(rows, large, keys) if repeated else rows.join(large, keys, "left").withColumn(
        "_part", F.when(F.col("_parts").isNotNull(), _own_part(rows)).otherwise(F.lit(0))).drop("_parts")
    parts = F.when(F.col("_parts").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)) \
        .otherwise(F.array(F.lit(0).cast("bigint")))
    copied = plain.join(large, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    joined = split.join(copied, [*keys, "_part"], "inner").drop("_part")
    if not repeated:
        return joined
    return joined.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).drop("_copies")


def _own_part(rows: DataFrame, shift: Column | int = 0) -> Column:
    return F.pmod(F.xxhash64(*[col(c) for c in flat_columns(rows)]) + shift, F.col("_parts"))


def _dealt(rows: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `_part` and `_copies`; the copies of a row of a large key fill its parts evenly."""
    counted = rows.join(large, keys, "left_semi").groupBy(*[col(c) for c in rows.columns]).agg(
        F.count(F.lit(1)).alias("_n")).join(large, keys)
    parts = F.col("_parts")
    places = F.sequence(F.lit(0).cast("bigint"), F.least("_n", parts) - 1)
    hot = counted.withColumn("_place", F.explode(places)).select(
        *[col(c) for c in rows.columns], _own_part(rows, F.col("_place")).alias("_part"),
        (F.floor(F.col("_n") / parts) + (F.col("_place") < F.col("_n") % parts).cast("bigint")).alias("_copies"))
    one = F.lit(1).cast("bigint")
    rest = rows.join(large, keys, "left_anti").withColumns({"_part": F.lit(0).cast("bigint"), "_copies": one})
    return hot.unionByName(rest)
