"""Order-dependent columns without putting a whole series into one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.operators.scratch import settle

BLOCK = 1_000_000
SMALL_SERIES = 1_000_000
OFFSET_BITS = 33


def dense_position(df: DataFrame, order_by: list[str], series: list[str] | None = None,
                   name: str = "position", small: int = SMALL_SERIES,
                   partitions: int | None = None) -> DataFrame:
    """Number the rows of each series 0, 1, 2, ... in the given order.

    Small tables (size checked) use a window. Larger ones are range-partitioned
    on (series, order), sorted, and kept in the checkpoint folder so that the
    partition number is data; a row's position is then its offset in the
    partition plus the rows of the series in earlier partitions. One series may
    fill any number of partitions. `order_by` must identify a row.
    """
    series = series or []
    if df.count() <= small:
        window = Window.partitionBy(*([col(s) for s in series] or [F.lit(0)])).orderBy(
            *[col(o) for o in order_by])
        return df.withColumn(name, F.row_number().over(window).cast("bigint") - 1)
    keys = [col(k) for k in series + order_by]
    ranged = df.repartitionByRange(*keys) if partitions is None else \
        df.repartitionByRange(partitions, *keys)
    placed = settle(ranged.sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({
        "_part": F.shiftright("_at", OFFSET_BITS),
        "_at": F.col("_at").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)),
    })
    runs = placed.groupBy(*[col(s) for s in series], "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*([col(s) for s in series] or [F.lit(0)])).orderBy(
        "_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
                           - F.col("_first")).drop("_first", "_rows")
    if not series:
        runs = F.broadcast(runs)  # one row per partition
    # Chosen by name, not dropped: the position itself may be called like a helper column.
    return placed.join(runs, [*series, "_part"]).select(
        *[col(c) for c in df.columns if c != name], (F.col("_at") + F.col("_shift")).alias(name))


def rolling_mean(df: DataFrame, value: Column, position: str, rows: dict[str, int],
                 series: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Add means over the last k rows (fewer at the start), one column per entry of `rows`.

    Works on a dense position: each block of positions is one window partition
    that also receives the last k-1 rows of the block before it.
    """
    series = series or []
    halo = max(rows.values()) - 1
    block = max(block, halo + 1)
    at = col(position)
    home = F.floor(at / F.lit(block)).cast("bigint")
    last = at % F.lit(block) >= F.lit(block - halo)
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(last, F.array("_home", F.col("_home") + 1))
                            .otherwise(F.array("_home"))))
    window = Window.partitionBy(*[col(s) for s in series], "_block").orderBy(at)
    means = {name: F.avg(value).over(window.rowsBetween(1 - k, 0)) for name, k in rows.items()}
    return spread.withColumns(means).where(F.col("_home") == F.col("_block")).drop(
        "_home", "_block")


def running_sum(df: DataFrame, value: Column, position: str, name: str,
                series: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Add the sum of all rows of the series up to and including this one.

    Sums inside each block of positions are windows; the totals of the blocks
    before it are added as one number per block.
    """
    series = series or []
    keys = [col(s) for s in series]
    blocked = df.withColumn("_block", F.floor(col(position) / F.lit(block)).cast("bigint"))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.sum("_total").over(earlier)).drop("_total")
    inside = Window.partitionBy(*keys, "_block").orderBy(col(position)).rowsBetween(
        Window.unboundedPreceding, 0)
    summed = blocked.withColumn("_sum", F.sum(value).over(inside))
    return summed.join(totals, [*series, "_block"]).withColumn(
        name, F.when(F.col("_before").isNull(), F.col("_sum")).otherwise(
            F.col("_sum") + F.col("_before"))).drop("_sum", "_before", "_block")
