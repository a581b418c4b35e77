"""Column helpers shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def normal_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_nested(f.dataType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def present(df: DataFrame, name: str) -> Column:
    """The cell with NaN read as NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def count_if(condition: Column) -> Column:
    """Rows where the condition holds; 0, not NULL, for an empty table."""
    return F.count(F.when(condition, F.lit(1)))


def lossless(df: DataFrame, name: str) -> Column:
    """A column whose text forms differ exactly if its values do: -0.0 is 0.0, an instant its microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col(name) + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name)).cast("string")
    return col(name) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else col(name).cast("string")
