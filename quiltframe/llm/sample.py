"""Seeded samples of a bounded number of rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARE = 4


def among_lowest(draw: Column, wanted: int, total: int) -> Column:
    """Whether a 64-bit hash is so low that about SPARE * wanted of `total` rows are.

    The `wanted` lowest are then found among few rows, however many tasks there are.
    """
    share = SPARE * max(wanted, 100) / max(1, total)
    return F.lit(True) if share >= 1 else draw < F.lit(int(share * 2 ** 64) - 2 ** 63)
