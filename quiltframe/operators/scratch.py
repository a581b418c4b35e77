"""Intermediate tables that survive the loss of executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where none is configured and the session is local, as in tests, a temporary
    one is made: the executors of a cluster would each write to a folder of their own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quiltframe-")
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below the scratch folder."""
    return f"{scratch_folder(spark).rstrip('/')}/quiltframe/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Unlike a checkpoint it is columnar: later readers fetch only the columns
    (and, with `partition_by`, the folders) they use.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once, cut its lineage and keep it in the checkpoint folder."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()
