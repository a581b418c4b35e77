"""Tables made from a template: one lazy projection over row ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.functions.draws import Draws
from quiltframe.operators.clean import clean
from quiltframe.operators.ordered import dense_position, rolling_mean, running_sum
from quiltframe.operators.validate import check_row_count, require_valid
from quiltframe.plans.specs import Context, Derived
from quiltframe.plans.template_specs import TEMPLATES

AS_OF = "2025-01-01 00:00:00"


def row_source(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """n rows numbered 0 to n - 1 in `row_id`."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.withColumnRenamed("id", "row_id")


def rows_of(df: DataFrame, key: str) -> DataFrame:
    """The keys of a table as row ids: one made row for each row of the table."""
    return df.select(col(key).cast("bigint").alias("row_id"))


def spread(rows: DataFrame) -> DataFrame:
    """Give every core row ids to work on when a scan has fewer splits than there are cores.

    Making a row costs far more than moving its id. Scans with enough splits,
    which is any large table, stay as they are. Meant for plans without a
    shuffle: counting the splits of any other plan would run it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, "row_id")


def template_columns(template: str) -> list[str]:
    return list(TEMPLATES[template])


def make_rows(rows: DataFrame, template: str, *, n: int | None = None, seed: int = 42,
              as_of: str = AS_OF, columns: list[str] | None = None, dense: bool = False) -> DataFrame:
    """Fill a template for the given row ids, keeping `row_id` as first column.

    Draws belong to fixed slots of the whole template, so asking for a subset
    of the columns gives the same values as making all of them. `dense` says that
    the ids are 0, 1, 2, ... without gaps.
    """
    if template not in TEMPLATES:
        raise ValueError(f"no template is called {template!r}")
    specs = TEMPLATES[template]
    if n is None:
        # Only the time series refers to the number of rows.
        n = rows.count() if template == "Time Series Data" else 0
    context, draws = Context(as_of, n), Draws(seed, template)
    drawn = {name: spec.build(draws, context)
             for name, spec in specs.items() if not isinstance(spec, Derived)}
    made = draws.attach(rows).select(
        "row_id", *[c.alias(name) for name, c in drawn.items()])
    for name, spec in specs.items():
        if isinstance(spec, Derived):
            made = made.withColumn(name, spec.build(draws, context))
    names = [name for name in specs if not name.startswith("_")]
    if template == "Time Series Data":
        # Row ids need not be dense; windows count rows.
        made = made.withColumn("_place", F.col("row_id")) if dense else dense_position(
            made, ["row_id"], name="_place")
        made = rolling_mean(made, F.col("value"), "_place",
                            {"moving_avg_7d": 7, "moving_avg_30d": 30})
        made = running_sum(made, F.col("_step"), "_place", "series_3")
        names = ["date", "value", "moving_avg_7d", "moving_avg_30d", "volatility", "anomaly",
                 "series_2", "series_3"]
    wanted = names if columns is None else [name for name in names if name in columns]
    return made.select("row_id", *[col(name) for name in wanted])


def generate_template(spark: SparkSession, template: str, n: int, *, seed: int = 42,
                      as_of: str = AS_OF, columns: list[str] | None = None,
                      cleaned: bool = False, fill: list[str] = (),
                      partitions: int | None = None) -> DataFrame:
    """n rows of a template. With `cleaned`, validated and cleaned as well, without dropping any."""
    if not template:
        raise ValueError("name a template")
    check_row_count(n)
    made = make_rows(row_source(spark, n, partitions), template, n=n, seed=seed, as_of=as_of,
                     columns=columns, dense=True)
    if cleaned:
        require_valid(made)
        made = clean(made, template, order_by=["row_id"], fill=list(fill), dedup={
            "remove_exact": False, "remove_near": False, "consistency_check": False, "auto_resolve": False})
    return made.drop("row_id")
