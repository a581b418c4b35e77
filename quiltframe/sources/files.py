"""Readers and writers. Output is a folder of part files, one per task."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.functions.cells import col


# Cells with quotes double them; outer spaces belong to the cell.
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# Times keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header. Types are inferred (one extra pass) unless a schema is given.

    Large files are split between tasks at line ends. Where cells hold line breaks ask for
    `multi_line`: a file then is one task's work (`write_csv` with `rows_per_file` bounds it).
    """
    reader = spark.read.options(header=True, multiLine=multi_line, **QUOTING)
    return reader.schema(schema).csv(path) if schema else \
        reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
              array: bool = False) -> DataFrame:
    """JSON lines, or with `array` files that hold one array of records each."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = 0) -> None:
    """`rows_per_file` bounds the part files (0: one per task), so that even multi-line ones are read in parallel."""
    df.write.mode(mode).options(header=True, maxRecordsPerFile=rows_per_file, **QUOTING, **TIMES).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(ignoreNullFields=False, **TIMES).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).parquet(path, partitionBy=partition_by)


def drop_time_zones(df: DataFrame, zone_columns: dict[str, str] | None = None,
                    zoned_texts: list[str] = ()) -> DataFrame:
    """Timestamps with a zone become timestamps without.

    A zoned column keeps the wall clock of the session zone. `zone_columns` maps
    a naive column to the column holding its zone, `zoned_texts` names text
    columns whose cells end in their own offset; both are put in UTC.
    """
    zone_columns = zone_columns or {}
    changed = {f.name: col(f.name).cast("timestamp_ntz") for f in df.schema.fields
               if isinstance(f.dataType, T.TimestampType)}
    for name, zone in zone_columns.items():
        changed[name] = F.convert_timezone(col(zone), F.lit("UTC"), col(name).cast("timestamp_ntz"))
    for name in zoned_texts:
        local = col(name).try_cast("timestamp").cast("timestamp_ntz")
        changed[name] = F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return df.withColumns(changed) if changed else df
