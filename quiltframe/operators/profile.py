"""Profiling: column statistics, types, semantic roles and table summaries."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import constants as K
from quiltframe.functions.cells import (
    col, count_if, flat_columns, is_missing, is_numeric, is_text, is_time, normal_name,
    numeric_columns, present, text_columns,
)
from quiltframe.functions.text import (
    as_number, digits, looks_boolean, strip, stripped_time, word_count,
)
from quiltframe.operators.frequency import distinct_counts, in_column_order, value_counts
from quiltframe.operators.order_stats import exact_quantiles

DATE_SHARE, EMAIL_SHARE, BOOLEAN_SHARE = 0.8, 0.6, 0.8
ID_DISTINCT, ID_SHAPE = 0.9, 0.7


def _share(test: Column) -> Column:
    """Average of a test over the present cells; NULL without any."""
    return F.avg(test.cast("double"))


STATS = ("email_share", "id_share", "boolean_share", "date_share", "number_share",
         "avg_length", "avg_words")


def column_stats(df: DataFrame) -> DataFrame:
    """One row per text or boolean column with everything type and role tests need.

    The cells are unpivoted to (column, value), so the plan does not grow with
    the width of the table. Shares are aggregated on the map side; the distinct
    counts come from one shuffle in which long texts travel as digests.
    """
    names = [f.name for f in df.schema.fields
             if is_text(f.dataType) or isinstance(f.dataType, T.BooleanType)]
    if not names:
        shares = "".join(f", {s} double" for s in STATS)
        return df.sparkSession.createDataFrame(
            [], f"column string, n_rows bigint, n_values bigint, n_distinct bigint{shares}")
    texts = df.select(*[strip(col(n).cast("string")).alias(n) for n in names])
    cell = F.col("value")
    shares = texts.unpivot([], [col(n) for n in names], "column", "value").groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(cell).alias("n_values"),
        _share(cell.rlike(K.EMAIL_CELL)).alias("email_share"),
        _share(cell.rlike(K.ID_CELL)).alias("id_share"),
        _share(looks_boolean(cell)).alias("boolean_share"),
        _share(F.when(cell.isNotNull(), stripped_time(cell).isNotNull())).alias("date_share"),
        _share(F.when(cell.isNotNull(), as_number(cell).isNotNull())).alias("number_share"),
        _share(F.length(cell)).alias("avg_length"),
        _share(word_count(cell)).alias("avg_words"))
    distinct = distinct_counts(value_counts(texts, names, digest_long=True))
    stats = shares.join(F.broadcast(distinct.select("column", "n_distinct")), "column", "left")
    return in_column_order(stats, names).select(
        "column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_values", "n_distinct")],
        *STATS)


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: T.DataType
    kind: str          # id, numeric, datetime or categorical
    role: str


class _Stats:
    """Collected statistics of one column; shares of an empty column are 0."""

    def __init__(self, values: dict | None):
        values = values or {}
        self.n = values.get("n_values") or 0
        self.rows = values.get("n_rows") or 0
        self.distinct = values.get("n_distinct") or 0
        self.ratio = self.distinct / self.n if self.n else 0.0
        for name in STATS:
            setattr(self, name, values.get(name) or 0.0)


def _has(name: str, parts: list[str]) -> bool:
    return any(p in name for p in parts)


def column_kind(name: str, dtype: T.DataType, s: _Stats) -> str:
    """The logical type of a column; the first rule that holds decides."""
    plain = normal_name(name)
    rules = [
        ("categorical", _has(plain, K.TEXT_BY_NAME) or plain in K.TEXT_BY_EXACT_NAME
            or plain.endswith("_pincode")),
        ("id", re.search(K.ID_COLUMN_FIT, name.strip()) is not None),
        ("id", s.n >= 2 and s.ratio >= ID_DISTINCT and s.id_share >= ID_SHAPE),
        ("numeric", is_numeric(dtype)),
        ("datetime", is_time(dtype)),
        ("categorical", isinstance(dtype, T.BooleanType) or s.n == 0),
        ("categorical", s.boolean_share >= BOOLEAN_SHARE),
        ("datetime", s.date_share > DATE_SHARE),
        ("numeric", s.number_share == 1.0),
    ]
    return next((kind for kind, holds in rules if holds), "categorical")


def column_role(name: str, kind: str, s: _Stats) -> str:
    """The semantic role of a column; the first rule that holds decides."""
    if kind != "categorical":
        return kind
    plain = normal_name(name)
    label_like = s.avg_length <= 40 and s.avg_words <= 6
    few = 0 < s.distinct <= max(25, int(0.5 * s.n))
    rules = [
        ("email", _has(plain, ["email", "e_mail"]) or s.email_share > EMAIL_SHARE),
        ("aadhaar", _has(plain, ["aadhaar", "aadhar"])),
        ("pan", plain in ("pan", "pan_number", "pan_card") or plain.endswith("_pan")),
        ("ifsc", "ifsc" in plain),
        ("upi", "upi" in plain or plain == "vpa"),
        ("pincode", _has(plain, ["pincode", "pin_code"])
            or plain in ("zip", "zipcode", "postal_code")),
        ("gstin", "gstin" in plain or plain in ("gst", "gst_number")),
        ("first_name", plain in ("first_name", "firstname", "fname", "given_name")),
        ("last_name", plain in ("last_name", "lastname", "lname", "surname", "family_name")),
        ("person_name", _has(plain, K.PERSON_NAME_PARTS) or plain in ("name", "account_name")
            or any(plain == k or plain.endswith("_" + k) for k in K.PERSON_ROLE_KEYS)),
        ("closed_categorical", _has(plain, K.VENDOR_PARTS)),
        ("city", _has(plain, K.CITY_PARTS)),
        ("state", plain in ("state", "province") or plain.endswith("_state")),
        ("country", plain in ("country", "nation", "country_name") or plain.endswith("_country")),
        ("address", _has(plain, K.ADDRESS_PARTS)),
        ("phone", _has(plain, K.PHONE_PARTS)),
        ("company", _has(plain, K.COMPANY_PARTS)),
        ("closed_categorical", few and (_has(plain, K.ENUM_NAME_PARTS) or s.ratio < 0.55)),
        ("job", _has(plain, K.JOB_PARTS) or plain in ("title", "role")),
        ("product", _has(plain, K.PRODUCT_PARTS)),
        ("closed_categorical", 0 < s.distinct <= max(50, s.n) and label_like),
        ("closed_categorical", s.distinct == 0 and label_like),
    ]
    return next((role for role, holds in rules if holds), "text_open")


def report_role(name: str, dtype: T.DataType, s: _Stats) -> str:
    """The shorter role cascade the quality report falls back to."""
    plain = normal_name(name)
    rules = [
        ("id", re.search(K.ID_COLUMN_REPORT, name) is not None),
        ("numeric", is_numeric(dtype)),
        # Share of all rows, missing ones included.
        ("datetime", is_time(dtype) or (s.rows and s.date_share * s.n / s.rows > DATE_SHARE)),
        ("email", "email" in plain or s.email_share > EMAIL_SHARE),
        ("person_name", _has(plain, K.REPORT_PERSON_PARTS) or plain == "name"),
        ("city", "city" in plain),
        ("phone", _has(plain, ["phone", "mobile"])),
        ("closed_categorical", s.distinct > 0 and s.ratio < 0.55),
    ]
    return next((role for role, holds in rules if holds), "text_open")


def _stats_by_column(df: DataFrame) -> dict[str, _Stats]:
    return {r["column"]: _Stats(r.asDict()) for r in column_stats(df).collect()}  # one row per column


def profile_columns(df: DataFrame) -> list[ColumnProfile]:
    stats, out = _stats_by_column(df), []
    for f in df.schema.fields:
        s = stats.get(f.name, _Stats(None))
        kind = column_kind(f.name, f.dataType, s)
        out.append(ColumnProfile(f.name, f.dataType, kind, column_role(f.name, kind, s)))
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, role) of a table."""
    return df.sparkSession.createDataFrame(
        [(p.name, p.kind, p.role) for p in profile_columns(df)],
        "column string, type string, role string")


def infer_report_roles(df: DataFrame, sample: DataFrame | None = None) -> dict[str, str]:
    """Roles by the short cascade, read from the sample where it has the column."""
    roles = {}
    own = [n for n in df.columns if sample is None or n not in sample.columns]
    for source, names in ((df.select(*[col(n) for n in own]), own),
                          (sample, [n for n in df.columns if n not in own])):
        if not names:
            continue
        part = source.select(*[col(n) for n in names])
        stats = _stats_by_column(part)
        for f in part.schema.fields:
            roles[f.name] = report_role(f.name, f.dataType, stats.get(f.name, _Stats(None)))
    return {n: roles[n] for n in df.columns}


# --- Context of a whole table --------------------------------------------

def city_hint_share(df: DataFrame, name: str) -> Column:
    """Aggregate: share of present cells naming an Indian city."""
    hints = "|".join(K.INDIA_CITY_HINTS)
    return _share(F.lower(strip(col(name).cast("string"))).rlike(hints))


def india_context(df: DataFrame) -> bool:
    """An Indian column name, or 30 % Indian cities in some city column."""
    names = " ".join(c.lower() for c in df.columns)
    if _has(names, K.INDIA_COLUMN_WORDS):
        return True
    cities = [c for c in df.columns
              if "city" in c.lower() or c.lower() in ("town", "village", "district")]
    if not cities:
        return False
    row = df.agg(*[city_hint_share(df, c).alias(c) for c in cities]).first()
    return any((row[c] or 0) >= 0.3 for c in cities)


def phone_style_stats(name: str) -> list[Column]:
    """Aggregates: shares of phones starting with 91 and of ten-digit phones."""
    number = digits(col(name).cast("string"))
    return [_share(number.startswith("91")).alias("starts_91"),
            _share(F.length(number) == 10).alias("ten_digits")]


def india_phone_style(df: DataFrame, phones: list[str], india_mode: bool) -> bool:
    for name in phones:
        row = df.agg(*phone_style_stats(name)).first()
        if (row["starts_91"] or 0) > 0.25 or (row["ten_digits"] or 0) > 0.4:
            return True
    return india_mode


def linked_groups(columns: list[str]) -> list[list[str]]:
    """Column groups that must be drawn from one sample row."""
    by_name, used, groups = {c.lower(): c for c in columns}, set(), []
    for names in K.LINKED_COLUMNS:
        found = [by_name[n] for n in names if n in by_name and by_name[n] not in used]
        if len(found) >= 2:
            groups.append(found)
            used.update(found)
    return groups


@dataclass(frozen=True)
class PersonColumns:
    first: str | None
    last: str | None
    full: str | None
    email: str | None


def person_columns(profiles: list[ColumnProfile]) -> PersonColumns:
    """The first column of each person role; the full name also by its usual names."""
    def first(role):
        return next((p.name for p in profiles if p.role == role), None)

    full = first("person_name") or next(
        (p.name for p in profiles if normal_name(p.name) in K.PERSON_FALLBACK_NAMES), None)
    return PersonColumns(first("first_name"), first("last_name"), full, first("email"))


def email_domains(df: DataFrame, names: list[str]) -> DataFrame:
    """The distinct text after the first @, lower-case, as column `domain`."""
    cells = df.select(F.array(*[col(n).cast("string") for n in names]).alias("cells")).select(
        F.explode("cells").alias("cell")).where(F.contains("cell", F.lit("@")))
    after = F.expr("substring(cell, instr(cell, '@') + 1)")
    return cells.select(F.lower(strip(after)).alias("domain")).distinct()


# --- Table summaries ------------------------------------------------------

def column_summary(df: DataFrame) -> DataFrame:
    """(column, type, unique, null_pct) for every flat column."""
    names = flat_columns(df)
    missing = df.agg(F.array(*[F.struct(
        F.lit(n).alias("column"), F.lit(df.schema[n].dataType.simpleString()).alias("type"),
        F.round(count_if(is_missing(df, n)) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 2)
        .alias("null_pct")) for n in names]).alias("rows")).select(F.inline("rows"))
    distinct = distinct_counts(value_counts(df, names, digest_long=True))
    return missing.join(F.broadcast(distinct), "column", "left").select(
        "column", "type", F.coalesce("n_distinct", F.lit(0)).alias("unique"), "null_pct")


def table_profile(df: DataFrame) -> DataFrame:
    """One row: records, columns by kind, missing cells, duplicate rows."""
    missing = sum((is_missing(df, n).cast("int") for n in df.columns), F.lit(0))
    rows = df.groupBy(*[col(c) for c in flat_columns(df)]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(missing).alias("missing"))
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_columns(df))).cast("bigint").alias("categorical_columns"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe_numeric(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    names = names or numeric_columns(df)
    moments = df.agg(F.array(*[F.struct(
        F.lit(n).alias("column"), F.count(present(df, n)).alias("count"),
        F.avg(present(df, n)).alias("mean"), F.stddev_samp(present(df, n)).alias("std"),
        F.min(present(df, n)).cast("double").alias("min"),
        F.max(present(df, n)).cast("double").alias("max")) for n in names]).alias("rows")
    ).select(F.inline("rows"))
    quarters = exact_quantiles(df, names, [0.25, 0.5, 0.75]).groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"q{int(p * 100)}")
        for p in (0.25, 0.5, 0.75)])
    # Both sides hold one row per column.
    return moments.join(F.broadcast(quarters), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
