"""The row-wise operators that hold no state and so work on streams as they are."""

from pyspark.sql import DataFrame

from quiltframe.operators.clean import cast_named_dates, strip_text, unify_booleans
from quiltframe.operators.privacy import mask_columns, redact_text

__all__ = ["cast_named_dates", "mask_columns", "redact_text", "strip_text", "unify_booleans",
           "clean_stream"]


def clean_stream(stream: DataFrame, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """Strip, cast and mask the rows of a streaming DataFrame."""
    return mask_columns(cast_named_dates(strip_text(stream)), kinds or {})
