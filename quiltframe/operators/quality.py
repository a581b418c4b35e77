"""Quality of a table, optionally against the sample it was made from.

Per-column scores come from shared inputs: one row-level aggregation, one table of
(column, value) counts and, against a sample, one full outer join of two such
tables. A report reads the table twice, not once per metric; what is left are
tables with one row per column.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe import constants as K
from quiltframe.functions.cells import (
    col, count_if, flat_columns, is_missing, is_numeric, is_text, is_time, present,
)
from quiltframe.functions.text import name_in_email, strip
from quiltframe.operators.fit import time_of
from quiltframe.operators.frequency import entropy, most_common_values, value_counts
from quiltframe.operators.profile import _share, infer_report_roles

METRICS = [
    "completeness", "id_uniqueness", "date_diversity", "diversity",
    "enum_fidelity", "name_email_coherence", "numeric_fidelity", "uniqueness",
]


def completeness(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row: share of present cells; 0 for an empty table."""
    if stats is not None:
        cells = F.sum("n_rows")
        return stats.agg(F.when(cells > 0, F.sum("n_values") / cells).otherwise(0.0)
                         .alias("completeness"))
    n, k = F.count(F.lit(1)), len(df.columns)
    missing = sum((count_if(is_missing(df, c)) for c in df.columns), F.lit(0))
    return df.agg(F.when(n * k > 0, 1 - missing / (n * F.lit(k))).otherwise(0.0)
                  .alias("completeness"))


def table_stats(df: DataFrame) -> DataFrame:
    """One row per flat column with all that column scores need, from two passes.

    n_rows, n_values, id_share (share of present cells shaped like ABC-123),
    n_times, first and last (cells read as dates; text and time columns only)
    come from one aggregation; n_distinct and entropy from one table of value
    counts in which long texts are digests.
    """
    return _with_value_stats(_cell_stats(df, times=True), df)


def column_uniqueness(df: DataFrame) -> DataFrame:
    """`table_stats` without reading any dates."""
    return _with_value_stats(_cell_stats(df, times=False), df)


def _cell_stats(df: DataFrame, times: bool) -> DataFrame:
    rows, none = [], F.lit(None).cast("timestamp_ntz")
    for name in flat_columns(df):
        dtype = df.schema[name].dataType
        shape = _share(col(name).cast("string").rlike(K.ID_CELL)) if is_text(dtype) else F.lit(0.0)
        dated = times and (is_text(dtype) or is_time(dtype))
        t = time_of(df, name) if dated else none
        rows.append(F.struct(
            F.lit(name).alias("column"), F.lit(is_text(dtype)).alias("is_text"),
            F.count(F.lit(1)).alias("n_rows"), F.count(present(df, name)).alias("n_values"),
            F.coalesce(shape, F.lit(0.0)).alias("id_share"),
            (F.count(t) if dated else F.lit(0).cast("bigint")).alias("n_times"),
            (F.min(t) if dated else none).alias("first"),
            (F.max(t) if dated else none).alias("last")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _with_value_stats(cells: DataFrame, df: DataFrame) -> DataFrame:
    values = value_counts(df, digest_long=True).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), entropy().alias("entropy"))
    return cells.join(F.broadcast(values), "column", "left").withColumn(  # one row per column
        "n_distinct", F.coalesce("n_distinct", F.lit(0)))


def _local(small: DataFrame) -> DataFrame:
    """A table of one row per column, computed once and kept as a literal table."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _ratio() -> Column:
    return F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).otherwise(0.0)


def privacy_score(stats: DataFrame) -> DataFrame:
    """Mean over columns of 1 - min(distinct / rows, 1); from `column_uniqueness`."""
    score = F.when(F.col("n_rows") > 0, 1 - F.least(_ratio(), F.lit(1.0))).otherwise(0.0)
    return stats.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("privacy_score"))


def open_uniqueness(stats: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Mean distinct / rows over open and id columns; NULL without any."""
    names = [c for c, r in roles.items() if r in K.OPEN_ROLES or r == "id"]
    return stats.where(F.col("column").isin(names)).agg(F.avg(_ratio()).alias("uniqueness"))


def id_uniqueness(stats: DataFrame, df: DataFrame) -> DataFrame:
    """Mean distinct / rows over id-named columns, else over id-shaped ones; 1.0 without any."""
    named = F.col("column").rlike(K.ID_COLUMN_REPORT)
    text = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    shaped = (F.col("column").isin(text) & (F.col("n_values") > 0) & (F.col("id_share") > 0.5)
              & (F.col("n_distinct") >= 0.95 * F.col("n_values")))
    return stats.agg(F.coalesce(
        F.avg(F.when(named, _ratio())), F.avg(F.when(shaped, _ratio())), F.lit(1.0)
    ).alias("id_uniqueness"))


def _diversity() -> Column:
    return F.when(F.col("n_distinct") > 1, F.col("entropy") / F.ln(F.col("n_distinct").cast("double"))
                  ).otherwise(0.0)


def diversity_by_column(stats: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_distinct, diversity): entropy relative to its maximum, ln of the labels."""
    return stats.where(F.col("column").isin(names)).select(
        "column", "n_distinct", _diversity().alias("diversity"))


def open_diversity(stats: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Mean normalized entropy of the open columns.

    An empty or constant column scores 0; without open columns the score is 1.
    """
    names = [c for c, r in roles.items() if r in K.OPEN_ROLES]
    return stats.where(F.col("column").isin(names)).agg(
        F.coalesce(F.avg(_diversity()), F.lit(1.0)).alias("diversity"))


def date_diversity_by_column(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(column, diversity) of columns that are dates in at least 80 % of the rows.

    Different texts may be one date, so the few text columns that qualify are
    counted again by their parsed values.
    """
    stats = _local(table_stats(df)) if stats is None else stats
    dated = stats.where((F.col("n_times") > 0) & (F.col("n_times") >= 0.8 * F.col("n_rows")))
    texts = [r["column"] for r in dated.where("is_text").select("column").collect()]
    distinct = dated.where("not is_text").select("column", F.col("n_distinct").alias("k"))
    if texts:
        parsed = df.select(*[time_of(df, n).cast("string").alias(n) for n in texts])
        distinct = distinct.unionByName(value_counts(parsed, texts).groupBy("column").agg(
            F.count(F.lit(1)).alias("k")))
    span = F.greatest(F.datediff("last", "first"), F.lit(0)).cast("bigint")
    room = F.greatest(F.lit(1), F.least(
        F.col("n_times"), F.when(span > 0, span + 1).otherwise(F.col("k"))))
    return dated.join(F.broadcast(distinct), "column").select(  # one row per column
        "column", F.least(F.lit(1.0), F.col("k") / room).alias("diversity"))


def date_diversity(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    return date_diversity_by_column(df, stats).agg(
        F.coalesce(F.avg("diversity"), F.lit(1.0)).alias("date_diversity"))


def enum_fidelity_by_column(df: DataFrame, sample: DataFrame, names: list[str]) -> DataFrame:
    """(column, vocabulary, distance, fidelity) of closed columns against the sample.

    vocabulary: share of the table's labels the sample knows; distance: total
    variation between the two label distributions.
    """
    made = value_counts(df, names, label=strip).withColumnRenamed("n", "made")
    seed = value_counts(sample, names, label=strip).withColumnRenamed("n", "seed")
    both = made.join(seed, ["column", "value"], "full_outer").select(
        "column", F.coalesce("made", F.lit(0)).alias("made"),
        F.coalesce("seed", F.lit(0)).alias("seed"))
    totals = both.groupBy("column").agg(
        F.sum("made").alias("made_total"), F.sum("seed").alias("seed_total"))
    gap = F.abs(F.col("made") / F.col("made_total") - F.col("seed") / F.col("seed_total"))
    return both.join(F.broadcast(totals), "column").where(  # one row per column
        "made_total > 0 and seed_total > 0").groupBy("column").agg(
        (count_if((F.col("made") > 0) & (F.col("seed") > 0)) / count_if(F.col("made") > 0))
        .alias("vocabulary"), (F.sum(gap) / 2).alias("distance")).withColumn(
        "fidelity", 0.5 * F.col("vocabulary") + 0.5 * (1 - F.col("distance")))


def closed_columns(df: DataFrame, sample: DataFrame, roles: dict[str, str]) -> list[str]:
    return [c for c in df.columns if roles.get(c) in K.CLOSED_ROLES and c in sample.columns]


def enum_fidelity(df: DataFrame, sample: DataFrame | None, roles: dict[str, str]) -> DataFrame:
    """Mean fidelity of the closed columns; columns empty on a side score 0; else NULL."""
    names = closed_columns(df, sample, roles) if sample is not None else []
    if not names:
        return df.sparkSession.createDataFrame([(None,)], "enum_fidelity double")
    total = F.coalesce(F.sum("fidelity"), F.lit(0.0))
    return enum_fidelity_by_column(df, sample, names).agg(
        (total / F.lit(len(names))).alias("enum_fidelity"))


def name_and_email_columns(df: DataFrame, roles: dict[str, str]) -> tuple[str | None, str | None]:
    def by_role(*wanted):
        return next((c for c, r in roles.items() if r in wanted and c in df.columns), None)

    name, email = by_role("person_name", "first_name"), by_role("email")
    if not (name and email):
        lower = {c: c.lower() for c in df.columns}
        name = name or next((c for c, low in lower.items() if "name" in low and "file" not in low), None)
        email = email or next((c for c, low in lower.items() if "email" in low), None)
    return name, email


def name_email_coherence(df: DataFrame, name: str | None, email: str | None) -> DataFrame:
    """Share of addresses whose local part holds a part of the name; NULL without any."""
    if not (name and email):
        return df.sparkSession.createDataFrame([(None,)], "name_email_coherence double")
    who, mail = col(name).cast("string"), col(email).cast("string")
    counted = F.contains(mail, F.lit("@")) & who.isNotNull() & ~who.isin("nan", "None")
    return df.agg(F.avg(F.when(counted, name_in_email(who, mail).cast("double")))
                  .alias("name_email_coherence"))


def _moments(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    def number(n):
        if is_numeric(df.schema[n].dataType):
            return present(df, n).cast("double")
        return col(n).try_cast("double")

    return df.agg(F.array(*[F.struct(
        F.lit(n).alias("column"), F.count(number(n)).alias(f"{prefix}_n"),
        F.avg(number(n)).alias(f"{prefix}_mean"),
        F.stddev_samp(number(n)).alias(f"{prefix}_std")) for n in names]).alias("rows")
    ).select(F.inline("rows"))


def numeric_fidelity_by_column(df: DataFrame, sample: DataFrame, names: list[str]) -> DataFrame:
    """(column, mean_score, spread_score); both 0.5 when a side has under two values."""
    both = _moments(df, names, "made").join(F.broadcast(_moments(sample, names, "seed")), "column")

    def spread(c):
        return F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))

    made, seed = spread("made_std"), spread("seed_std")
    near = F.abs(F.col("made_mean") - F.col("seed_mean")) <= 2.0 * seed
    enough = (F.col("made_n") >= 2) & (F.col("seed_n") >= 2)
    return both.select(
        "column", F.when(enough, F.when(near, 1.0).otherwise(0.5)).alias("mean_score"),
        F.when(enough, F.least(made, seed) / F.greatest(made, seed)).alias("spread_score"))


def numeric_fidelity(df: DataFrame, sample: DataFrame | None, roles: dict[str, str]) -> DataFrame:
    """Mean of all column scores; a column with too few values adds one score of 0.5."""
    names = [c for c in df.columns
             if roles.get(c) == "numeric" and sample is not None and c in sample.columns]
    if not names:
        return df.sparkSession.createDataFrame([(None,)], "numeric_fidelity double")
    scores = numeric_fidelity_by_column(df, sample, names)
    total = F.sum(F.coalesce(F.col("mean_score") + F.col("spread_score"), F.lit(0.5)))
    parts = F.sum(F.when(F.col("mean_score").isNull(), 1).otherwise(2))
    return scores.agg((total / parts).alias("numeric_fidelity"))


def column_statistics(df: DataFrame) -> DataFrame:
    """(column, mean, std, min, max, unique, most_common); the last two for non-numeric columns."""
    names = flat_columns(df)
    numbers = [n for n in names if is_numeric(df.schema[n].dataType)]
    others = [n for n in names if n not in numbers]
    parts = []
    if numbers:
        parts.append(df.agg(F.array(*[F.struct(
            F.lit(n).alias("column"), F.avg(present(df, n)).alias("mean"),
            F.stddev_samp(present(df, n)).alias("std"),
            F.min(present(df, n)).cast("double").alias("min"),
            F.max(present(df, n)).cast("double").alias("max")) for n in numbers]).alias("rows")
        ).select(F.inline("rows")).select(
            "*", F.lit(None).cast("bigint").alias("unique"),
            F.lit(None).cast("string").alias("most_common")))
    if others:
        common = [(n, count, value) for n, (count, value) in most_common_values(df, others).items() if count]
        found = df.sparkSession.createDataFrame(common, "column string, unique bigint, most_common string")
        empty = F.lit(None).cast("double")
        parts.append(found.select("column", *[empty.alias(n) for n in ("mean", "std", "min", "max")],
                                  "unique", "most_common"))
    return reduce(DataFrame.unionByName, parts)


def overall_score() -> Column:
    """Mean of the metrics that are defined, three decimals."""
    known = F.filter(F.array(*[F.col(m) for m in METRICS]), lambda x: x.isNotNull())
    return F.bround(F.aggregate(known, F.lit(0.0).cast("double"), lambda a, x: a + x)
                    / F.size(known), 3)


def quality_report(df: DataFrame, sample: DataFrame | None = None,
                   roles: dict[str, str] | None = None) -> DataFrame:
    """One row with every metric, the overall score first. Undefined metrics are NULL."""
    roles = roles or infer_report_roles(df, sample)
    stats = _local(table_stats(df))
    name, email = name_and_email_columns(df, roles)
    whole = stats if len(flat_columns(df)) == len(df.columns) else None
    parts = [
        completeness(df, whole), id_uniqueness(stats, df), date_diversity(df, stats),
        open_diversity(stats, roles), enum_fidelity(df, sample, roles),
        name_email_coherence(df, name, email), numeric_fidelity(df, sample, roles),
        open_uniqueness(stats, roles), privacy_score(stats),
    ]
    # Every part is exactly one row.
    row = reduce(lambda a, b: a.join(F.broadcast(b)), parts)
    return row.select(overall_score().alias("overall_score"), *METRICS, "privacy_score")


def simple_quality(df: DataFrame) -> DataFrame:
    """One row: completeness, mean distinct / rows and their average; fixed 0.5 for the rest."""
    stats = column_uniqueness(df).agg(F.coalesce(F.avg(_ratio()), F.lit(0.0)).alias("uniqueness"))
    both = completeness(df).join(F.broadcast(stats))  # one row each
    return both.select(
        ((F.col("completeness") + F.col("uniqueness")) / 2).alias("overall_score"),
        "completeness", "uniqueness", F.lit(0.5).alias("diversity"), F.lit(0.5).alias("privacy_score"))


def score_band(score: Column) -> Column:
    """good from 0.7, mid from 0.4, low below; NULL stays NULL."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(score.isNull(), None).when(held >= 0.7, "good").when(held >= 0.4, "mid") \
        .otherwise("low")


def score_percent(score: Column, clamp: bool = True) -> Column:
    """A score as percent text with one decimal, N/A when missing."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if clamp else score
    return F.when(score.isNull(), "N/A").otherwise(
        F.concat(F.format_string("%.1f", held * 100), F.lit("%")))

