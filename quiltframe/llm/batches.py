"""How much of a table Python workers are handed at once."""

from pyspark.sql import SparkSession

# Spark's 64 MB of texts in a batch are several times as much in a Python worker and in Arrow's buffers of the executor.
BATCH = "4m"


def bound_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers about BATCH at once; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
