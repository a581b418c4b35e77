"""Finding and masking personal data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.constants import PII_PATTERNS
from quiltframe.functions.cells import col, count_if, text_columns
from quiltframe.functions.masks import MASKS, holds, redact


def detect_pii(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, pattern, matches): cells of each text column that hold each kind of data."""
    names = text_columns(df) if names is None else names
    rows = [F.struct(F.lit(n).alias("column"), F.lit(kind).alias("pattern"),
                     count_if(holds(col(n), kind)).alias("matches"))
            for n in names for kind in PII_PATTERNS]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, pattern string, matches bigint")
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("matches > 0")


def mask_columns(df: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Mask whole cells that match, per column and kind of data, in the order given.

    Which masks a cell gets is decided on its original text.
    """
    masked = {}
    for name, patterns in kinds.items():
        cell = col(name)
        for kind in patterns:
            if kind in MASKS:
                cell = F.when(holds(col(name), kind), MASKS[kind](cell)).otherwise(cell)
        masked[name] = cell
    return df.withColumns(masked) if masked else df


def apply_privacy(df: DataFrame) -> DataFrame:
    """Detect, then mask: one aggregation and one projection."""
    found: dict[str, list[str]] = {}
    order = list(PII_PATTERNS)
    rows = detect_pii(df).collect()  # columns times patterns at most
    for r in sorted(rows, key=lambda r: order.index(r["pattern"])):
        found.setdefault(r["column"], []).append(r["pattern"])
    return mask_columns(df, found)


def redact_text(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Replace personal data inside running text and keep the rest of it."""
    names = text_columns(df) if names is None else names
    return df.withColumns({n: redact(col(n)) for n in names}) if names else df
