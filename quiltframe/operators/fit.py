"""Fitting: one model per column, the correlation matrix and the drawing vocabularies.

Only statistics travel to the driver (a few numbers per column). Value
frequencies stay DataFrames and are joined when rows are made.
"""

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe import constants as K
from quiltframe.functions.cells import col, present
from quiltframe.functions.text import as_number, as_time, digits, model_label, strip
from quiltframe.operators.cross import cross_products
from quiltframe.operators.frequency import distinct_counts, value_counts
from quiltframe.operators.lookup import Vocabulary, vocabulary_sizes
from quiltframe.operators.profile import (
    ColumnProfile, PersonColumns, email_domains, india_context, india_phone_style, linked_groups,
    person_columns, profile_columns,
)
from quiltframe.operators.scratch import store

KDE_MIN_VALUES = 5
DRAWN_BY_LABEL = [*K.CLOSED_ROLES, "city", "pincode", "text_open"]
NUMBERED = r"^(.*?)(\d+)$"


@dataclass(frozen=True)
class NumericModel:
    n: int = 0
    mean: float = 0.0
    deviation: float = 1.0
    low: float = 0.0
    high: float = 1.0
    decimals: int = 0
    six_digit: bool = False

    @property
    def bandwidth(self) -> float:
        """Kernel width by Scott's rule for one dimension (not scaled by deviation)."""
        return self.n ** (-1 / 5)

    @property
    def smooth(self) -> bool:
        return self.n >= KDE_MIN_VALUES


@dataclass(frozen=True)
class TimeModel:
    n: int = 0
    first: object = None
    last: object = None
    date_only: bool = True
    distinct: int = 0

    @property
    def span_seconds(self) -> int:
        return int((self.last - self.first).total_seconds()) if self.first else 0

    @property
    def span_days(self) -> int:
        return (self.last.date() - self.first.date()).days if self.first else 0


@dataclass(frozen=True)
class IdModel:
    prefix: str = ""
    width: int = 5
    start: int = 1
    uuid: bool = False


@dataclass
class TableModel:
    """Everything synthesis needs to know about a sample."""
    sample: DataFrame
    profiles: list[ColumnProfile]
    numeric: dict[str, NumericModel] = field(default_factory=dict)
    times: dict[str, TimeModel] = field(default_factory=dict)
    ids: dict[str, IdModel] = field(default_factory=dict)
    shortest_label: dict[str, int] = field(default_factory=dict)
    correlated: list[str] = field(default_factory=list)
    correlation: list[list[float]] | None = None
    groups: list[list[str]] = field(default_factory=list)
    person: PersonColumns = PersonColumns(None, None, None, None)
    india_mode: bool = False
    india_phone: bool = False
    label_table: DataFrame | None = None     # column, value, n of the columns drawn by label
    number_table: DataFrame | None = None    # the same for numeric columns, values as DOUBLE
    sizes: dict = field(default_factory=dict)

    @property
    def roles(self) -> dict[str, str]:
        """Semantic roles; a column paired as full name counts as one."""
        return {p.name: "person_name" if p.name == self.person.full else p.role
                for p in self.profiles}

    @property
    def kinds(self) -> dict[str, str]:
        return {p.name: p.kind for p in self.profiles}

    def count_values(self) -> None:
        """Count the values of all columns drawn by frequency: two passes over the sample
        whatever the number of columns, kept in the scratch folder by column."""
        by_label = [n for n, r in self.roles.items()
                    if self.kinds[n] == "categorical" and r in DRAWN_BY_LABEL]
        by_number = [n for n, m in self.numeric.items() if m.smooth]
        tables = []
        if by_label:
            counts = value_counts(self.sample, by_label, label=model_label)
            self.label_table = store(counts, "labels", ["column"])
            tables.append(self.label_table)
        if by_number:
            wide = self.sample.select(*[_number(self.sample, n).alias(n) for n in by_number])
            cells = wide.unpivot([], [col(n) for n in by_number], "column", "value")
            counts = cells.where("value is not null").groupBy("column", "value").agg(
                F.count(F.lit(1)).alias("n"))
            self.number_table = store(counts, "numbers", ["column"])
            tables.append(self.number_table)
        for table in tables:
            for row in table.groupBy("column").agg(*vocabulary_sizes()).collect():
                self.sizes[row["column"]] = (row["total"], row["values"], row["bytes"])

    def _column_of(self, table: DataFrame, name: str) -> DataFrame:
        return table.where(F.col("column") == name).select("value", "n")

    def labels(self, name: str) -> Vocabulary:
        """The labels of a categorical column by frequency."""
        return Vocabulary(self._column_of(self.label_table, name), *self.sizes.get(name, (0, 0, 0)))

    def numbers(self, name: str) -> Vocabulary:
        """The values of a numeric column by frequency."""
        return Vocabulary(self._column_of(self.number_table, name), *self.sizes.get(name, (0, 0, 0)))

    def moments(self, name: str) -> DataFrame:
        """(value, n) of the distinct times of a datetime column, each counted once."""
        times = self.sample.select(time_of(self.sample, name).alias("value"))
        return times.where("value is not null").distinct().withColumn("n", F.lit(1).cast("bigint"))

    def distinct_labels(self, name: str) -> Vocabulary:
        """The labels of a column, each counted once."""
        known = self.labels(name)
        once = known.freq.select("value", F.lit(1).cast("bigint").alias("n"))
        return Vocabulary(once, known.values, known.values, known.bytes)

    def postcodes(self, name: str) -> DataFrame:
        """The distinct six-digit codes of a column."""
        codes = self.labels(name).freq.select(digits(F.col("value")).alias("value"))
        return codes.where(F.length("value") == 6).distinct().withColumn(
            "n", F.lit(1).cast("bigint"))

    def domains(self) -> DataFrame:
        found = email_domains(self.sample, [n for n, r in self.roles.items() if r == "email"])
        return found.select(F.col("domain").alias("value"), F.lit(1).cast("bigint").alias("n"))

    def tuples(self, names: list[str]) -> DataFrame:
        """(value, n) of the value combinations of several columns, as structs."""
        rows = self.sample.select(F.struct(*[col(n) for n in names]).alias("value"))
        return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _number(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        return present(df, name).cast("double")
    return as_number(col(name))


def time_of(df: DataFrame, name: str) -> Column:
    """A column as timestamp without zone: zoned values keep their local wall clock."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name).cast("timestamp_ntz")
    return as_time(col(name).cast("string"))


# --- Model aggregates: each is one struct inside a single aggregation ------

def numeric_aggregate(x: Column) -> Column:
    tol = F.lit(1e-9)
    return F.struct(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"),
        F.min(x).alias("low"), F.max(x).alias("high"),
        F.bool_and(F.abs(x - F.rint(x)) <= tol).alias("whole"),
        F.bool_and((x >= 100000) & (x <= 999999)).alias("six_digit"))


def time_aggregate(t: Column) -> Column:
    return F.struct(
        F.count(t).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"),
        F.bool_and(t == F.date_trunc("day", t).cast("timestamp_ntz")).alias("date_only"))


def distinct_times(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Distinct times per datetime column: one shuffle of (column, time) pairs.

    Counted apart from the other statistics, whose buffers would otherwise be
    kept once per distinct time.
    """
    if not names:
        return {}
    times = df.select(*[time_of(df, n).cast("string").alias(n) for n in names])
    return {r["column"]: r["n_distinct"]
            for r in distinct_counts(value_counts(times, names)).collect()}


def id_aggregate(v: Column) -> Column:
    """Counts and extremes of prefixes and numbers of an identifier column."""
    shaped = v.rlike(K.ID_CELL)
    prefix = F.when(shaped, F.regexp_extract(v, NUMBERED, 1))
    tail = F.when(v.rlike(NUMBERED), F.regexp_extract(v, NUMBERED, 2))
    return F.struct(
        F.count(v).alias("n"), F.count(F.when(shaped, 1)).alias("shaped"),
        F.min(prefix).alias("prefix"), F.max(prefix).alias("last_prefix"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.count(tail).alias("numbered"), F.max(F.length(tail)).alias("width"),
        F.max(tail.try_cast("decimal(38,0)")).alias("top"))


def numeric_model(name: str, row) -> NumericModel:
    if not row["n"]:
        return NumericModel()

    def finite(x, default):
        return default if x is None or x != x or abs(x) == float("inf") else float(x)

    mean = finite(row["mean"], 0.0)
    deviation = finite(row["deviation"], 1.0)
    if row["n"] < 2 or deviation <= 0:
        deviation = 1.0
    decimals = 0 if row["whole"] or not re.search(K.DECIMAL_COLUMN, name) else 2
    return NumericModel(row["n"], mean, deviation, finite(row["low"], mean),
                        finite(row["high"], mean), decimals,
                        decimals == 0 and bool(row["six_digit"]))


def time_model(row, distinct: int) -> TimeModel:
    if not row["n"]:
        return TimeModel()
    return TimeModel(row["n"], row["first"], row["last"], bool(row["date_only"]), distinct)


def id_model(row, common_prefix) -> IdModel:
    """Prefix, number width and next number, or UUIDs where no numbering shows.

    `common_prefix` is called only when the most frequent prefix is needed.
    The next number exceeds every trailing number of the sample, so a made id
    never repeats a sample id.
    """
    if not row["n"] or row["top"] is None:
        return IdModel(uuid=True)
    start = int(row["top"]) + 1
    if row["shaped"] == row["n"]:
        if row["prefix"] == row["last_prefix"]:
            return IdModel(row["prefix"], row["width"], start)
        # The common prefix of a set is that of its lowest and highest member.
        shared = os.path.commonprefix([row["lowest"], row["highest"]])
        return IdModel(re.sub(r"\d+$", "", shared), row["width"], start)
    if row["numbered"] >= 0.7 * row["n"]:
        return IdModel(common_prefix(), row["width"], start)
    return IdModel(uuid=True)


def _top_prefix(sample: DataFrame, name: str):
    def find() -> str:
        text = strip(col(name).cast("string"))
        prefixes = sample.where(text.rlike(NUMBERED)).groupBy(
            F.regexp_extract(text, NUMBERED, 1).alias("p")).count()
        row = prefixes.orderBy(F.desc("count"), "p").limit(1).first()
        return row["p"] if row else ""
    return find


FEW_PAIRS = 10


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair, over rows where both are present.

    NULL where a column does not vary over those rows. Up to FEW_PAIRS pairs share one
    aggregation of built-in functions; more columns go through one scan that gathers
    cross products in blocks (`cross_products`).
    """
    x = {n: _number(df, n) for n in names}
    if len(names) * (len(names) + 1) // 2 > FEW_PAIRS:
        half = cross_products(df.select(*[x[n].alias(f"x{i}") for i, n in enumerate(names)]), names)
    else:
        def r(a, b):
            both = x[a].isNotNull() & x[b].isNotNull()
            spread = F.stddev_pop(F.when(both, x[a])) * F.stddev_pop(F.when(both, x[b]))
            # `corr` itself fails on columns that do not vary.
            return F.covar_pop(x[a], x[b]) / F.nullif(spread, F.lit(0.0))

        half = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r"))
                                for i, a in enumerate(names) for b in names[i:]]).alias("pairs")
                      ).select(F.inline("pairs"))
    mirrored = half.select("a", "b", "r", F.explode(
        F.when(F.col("a") == F.col("b"), F.array(F.lit(False)))
        .otherwise(F.array(F.lit(False), F.lit(True)))).alias("_flip"))
    return mirrored.select(
        F.when(F.col("_flip"), F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(F.col("_flip"), F.col("a")).otherwise(F.col("b")).alias("b"), "r")


def fit(sample: DataFrame) -> TableModel:
    """Model a prepared sample in a fixed number of passes: profile, column models,
    distinct times, and the values of labels and numbers drawn by frequency."""
    profiles = profile_columns(sample)
    model = TableModel(sample, profiles)
    model.groups = linked_groups(sample.columns)
    model.person = person_columns(profiles)
    model.india_mode = india_context(sample)
    model.india_phone = india_phone_style(
        sample, [p.name for p in profiles if p.role == "phone"], model.india_mode)
    grouped = {c for group in model.groups for c in group}
    model.correlated = [p.name for p in profiles if p.kind == "numeric" and p.name not in grouped]

    parts: list[Column] = []
    for p in profiles:
        text = strip(col(p.name).cast("string"))
        part = {
            "numeric": lambda: numeric_aggregate(_number(sample, p.name)),
            "datetime": lambda: time_aggregate(time_of(sample, p.name)),
            "id": lambda: id_aggregate(text),
            "categorical": lambda: F.struct(F.min(F.length(model_label(text))).alias("shortest")),
        }[p.kind]()
        parts.append(part.alias(p.name))
    row = sample.agg(*parts).first()
    distinct = distinct_times(sample, [p.name for p in profiles if p.kind == "datetime"])

    for p in profiles:
        if p.kind == "numeric":
            model.numeric[p.name] = numeric_model(p.name, row[p.name])
        elif p.kind == "datetime":
            model.times[p.name] = time_model(row[p.name], distinct.get(p.name, 0))
        elif p.kind == "id":
            model.ids[p.name] = id_model(row[p.name], _top_prefix(sample, p.name))
        else:
            model.shortest_label[p.name] = row[p.name]["shortest"] or 1
    names = model.correlated
    if len(names) > 1:
        found = correlations(sample, names).collect()  # columns squared
        r = {(pair["a"], pair["b"]): pair["r"] for pair in found}
        model.correlation = [[1.0 if a == b else r[a, b] for b in names] for a in names]
    model.count_values()
    return model
