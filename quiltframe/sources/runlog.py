"""The log of generation runs: an append-only Parquet table."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltframe.functions.cells import col

SHOWN = ["timestamp", "data_type", "records", "columns", "generation_time", "quality_score"]
# Column, its source field in a run, type, value when the field is missing.
FIELDS = [
    ("data_type", "type", "string", "Unknown"),
    ("records", "records", "bigint", 0),
    ("columns", "columns", "bigint", 0),
    ("generation_time", "time", "double", 0.0),
    ("quality_score", "quality", "double", 0.0),
]


def run_rows(runs: DataFrame) -> DataFrame:
    """Bring run records to the log's columns; missing fields get their defaults.

    Every column that is no known field goes into the metadata text as JSON. A
    run without an id is numbered by its time in microseconds.
    """
    known = {source for _, source, _, _ in FIELDS} | {"timestamp", "id"}
    extra = [c for c in runs.columns if c not in known]
    metadata = F.to_json(F.struct(*[col(c) for c in extra])) if extra else F.lit("{}")
    stamp = col("timestamp").cast("string") if "timestamp" in runs.columns else \
        F.current_timestamp().cast("string")
    number = col("id").cast("bigint") if "id" in runs.columns else \
        F.unix_micros(F.to_timestamp(stamp))
    return runs.select(number.alias("id"), stamp.alias("timestamp"), *[
        F.coalesce(col(source).cast(kind) if source in runs.columns else F.lit(None).cast(kind),
                   F.lit(default).cast(kind)).alias(name)
        for name, source, kind, default in FIELDS], metadata.alias("metadata"))


def append_runs(runs: DataFrame, path: str) -> None:
    run_rows(runs).write.mode("append").parquet(path)


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """Add one run given as a dict with type, records, columns, time, quality, metadata."""
    stamp = datetime.now().isoformat()
    row = [(stamp, run.get("type"), run.get("records"), run.get("columns"),
            float(run.get("time") or 0), float(run.get("quality") or 0))]
    frame = spark.createDataFrame(row, "timestamp string, type string, records bigint, "
                                       "columns bigint, time double, quality double")
    for key, value in (run.get("metadata") or {}).items():
        frame = frame.withColumn(key, F.lit(value))
    append_runs(frame, path)


def read_runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest runs first."""
    return spark.read.parquet(path).orderBy(F.desc("id")).limit(limit).select(*SHOWN)
