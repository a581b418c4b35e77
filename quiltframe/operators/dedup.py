"""Exact duplicates, conflicting copies, and the full deduplication run.

Rows of one key are reduced by `row_number() = 1`, which Spark turns into a
per-task group limit before the shuffle: a key holding a third of the table
sends one row per map task, not all of its rows, to a single task.
"""

from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltframe.constants import (
    KEY_ID_WORDS, KEY_PRESETS, KEY_TIME_WORDS, SIMILARITY_THRESHOLD,
)
from quiltframe.functions.cells import col, flat_columns, is_missing, is_text, lossless
from quiltframe.functions.text import as_time
from quiltframe.operators.frequency import distinct_counts, in_column_order, value_counts
from quiltframe.operators.near import drop_near_duplicates
from quiltframe.operators.scratch import store
from quiltframe.operators.skew import join_by_key


@dataclass(frozen=True)
class KeyPatterns:
    """Column groups deduplication works with, each in the table's column order."""
    id_columns: list[str]
    timestamp_columns: list[str]
    unique_columns: list[str]
    conflict_columns: list[str]
    strict_columns: list[str]


def key_patterns(columns: list[str], data_type: str = "unknown") -> KeyPatterns:
    """Find key, conflict and time columns by name and by the preset of the data type."""
    def holding(words):
        return [c for c in columns if any(w in c.lower() for w in words)]

    preset = next(
        (groups for kind, groups in KEY_PRESETS.items()
         if kind in data_type.lower() or holding([kind])), {})
    return KeyPatterns(
        holding(KEY_ID_WORDS), holding(KEY_TIME_WORDS), holding(preset.get("unique", [])),
        holding(preset.get("conflict", [])), holding(preset.get("strict", [])))


def _keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def _order(order_by: list[str], last: bool = False) -> list[Column]:
    return [col(o).desc_nulls_last() if last else col(o).asc_nulls_last() for o in order_by]


def drop_exact(df: DataFrame, keys: list[str] | None = None,
               order_by: list[str] | None = None) -> DataFrame:
    """One row per whole-row value or, with keys, the last row of each key.

    NULL keys count as equal. Columns in `order_by` that only number the rows
    are not part of the whole-row comparison.
    """
    if keys:
        return _keep_first(df, keys, _order(order_by or df.columns, last=True))
    if not order_by or not set(df.columns) - set(order_by):
        return df.dropDuplicates()
    return _keep_first(df, [c for c in df.columns if c not in order_by], _order(order_by))


def null_count(df: DataFrame, names: list[str] | None = None) -> Column:
    """Missing cells of a row: the lower, the more complete."""
    names = names or df.columns
    return sum((is_missing(df, n).cast("int") for n in names), F.lit(0))


def completeness(df: DataFrame, names: list[str] | None = None) -> Column:
    """Share of present cells of a row."""
    names = names or df.columns
    return (F.lit(len(names)) - null_count(df, names)) / F.lit(len(names))


def resolve_conflicts(df: DataFrame, key: str, conflicts: list[str]) -> DataFrame:
    """Set conflicting columns to the most frequent value of their key.

    The lowest value wins ties; a key of NULL is left alone. Values are counted
    per (key, value) first, so no task holds all rows of a key.
    """
    conflicts = [c for c in conflicts if c in df.columns]
    if not conflicts:
        return df
    keyed = df.where(col(key).isNotNull())
    modes = None
    for name in conflicts:
        counts = keyed.groupBy(col(key), col(name)).agg(F.count(F.lit(1)).alias("_n"))
        # NULL is no candidate, but a key with only NULLs keeps its rows.
        rank = F.struct(col(name).isNull(), -F.col("_n"), col(name))
        best = counts.groupBy(col(key)).agg(
            F.min_by(col(name), rank).alias(f"_mode_{name}"), F.sum("_n").alias("_rows"))
        modes = best if modes is None else modes.join(best.drop("_rows"), key)
    joined = join_by_key(keyed, store(modes), [key], "_rows", repeated=True)
    settled = joined.withColumns({n: col(f"_mode_{n}") for n in conflicts}).select(
        *[col(c) for c in df.columns])
    return settled.unionByName(df.where(col(key).isNull()))


def keep_latest(df: DataFrame, time: str, keys: list[str] | None = None,
                order_by: list[str] | None = None) -> DataFrame:
    """The row with the latest time per key (per whole row without keys)."""
    if is_text(df.schema[time].dataType):
        df = df.withColumn(time, as_time(col(time)))
    if not keys:
        return drop_exact(df, None, order_by)
    return _keep_first(df, keys, [col(time).desc_nulls_last(), *_order(order_by or df.columns)])


def keep_most_complete(df: DataFrame, keys: list[str] | None = None,
                       order_by: list[str] | None = None) -> DataFrame:
    """The row with the fewest gaps per key (per whole row without keys)."""
    if not keys:
        return drop_exact(df, None, order_by)
    return _keep_first(df, keys, [null_count(df), *_order(order_by or df.columns)])


# --- Analysis -------------------------------------------------------------

def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: rows, rows that repeat an earlier one, and their percentage."""
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    total, repeats = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return copies.agg(
        total.alias("total_rows"), repeats.alias("duplicate_rows"),
        F.when(total > 0, repeats / total * 100).otherwise(0.0).alias("duplicate_percentage"))


def duplicate_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, duplicates): cells repeating an earlier cell, NULL being one value."""
    names = names or flat_columns(df)
    stats = distinct_counts(value_counts(df, names, digest_long=True))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    missing = F.col("rows") - F.coalesce("n_values", F.lit(0))
    repeats = (F.coalesce("n_values", F.lit(0)) - F.coalesce("n_distinct", F.lit(0))
               + F.greatest(missing - 1, F.lit(0)))
    return (in_column_order(stats, names).join(F.broadcast(total))  # total is one row
            .select("column", repeats.alias("duplicates")).where("duplicates > 0"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every row value that occurs more than once, with its number of copies."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(
        F.count(F.lit(1)).alias("copies")).where("copies > 1")


def mark_duplicates(df: DataFrame, order_by: list[str], keep: str | bool = "first") -> DataFrame:
    """Add `is_duplicate`: repeats an earlier row (keep='first'), a later one
    ('last'), or has any copy at all (False). `order_by` numbers the rows and is
    not compared."""
    names = [c for c in df.columns if c not in order_by]
    at = F.struct(*[col(o) for o in order_by])
    row = F.struct(*[lossless(df, n).alias(n) for n in names])
    # A digest makes one non-null join key of all compared columns.
    keyed = df.withColumn("_row", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))
    kept = F.min(at) if keep == "first" else F.max(at)
    groups = keyed.groupBy("_row").agg(kept.alias("_kept"), F.count(F.lit(1)).alias("_copies"))
    joined = join_by_key(keyed, store(groups).withColumn("_n", F.col("_copies")), ["_row"], "_n")
    flag = F.col("_copies") > 1 if keep is False else at != F.col("_kept")
    return joined.withColumn("is_duplicate", flag).select(
        *[col(c) for c in df.columns], "is_duplicate")


# --- The whole run --------------------------------------------------------

def _rows_seen(seen: Observation, table: DataFrame) -> int:
    """The observed count; a table that the optimizer took out of the plan, as over no rows, is counted itself."""
    try:
        return seen.get["rows"]
    except (KeyError, Py4JJavaError):  # nothing was observed: there is no row to read
        return table.count()


@dataclass
class DedupRun:
    """The deduplicated table, and the row counts between the steps."""
    df: DataFrame
    patterns: KeyPatterns
    _watched: list[tuple[str, Observation, DataFrame]] = field(default_factory=list)
    _counts: list[tuple[str, int]] | None = None

    def watch(self, name: str, table: DataFrame) -> DataFrame:
        """The table, its rows counted by whatever job first computes it."""
        seen = Observation()
        self._watched.append((name, seen, table))
        return table.observe(seen, F.count(F.lit(1)).alias("rows"))

    def counts(self) -> list[tuple[str, int]]:
        """(step, rows after it): all of them from one computation of the result, without passes of their own."""
        if self._counts is None:
            self.df.write.format("noop").mode("overwrite").save()
            self._counts = [(name, _rows_seen(seen, table)) for name, seen, table in self._watched]
        return self._counts

    def report(self) -> DataFrame:
        """(step, before, after, removed), one row per step and one in total."""
        counts = self.counts()
        rows = [(name, before, after, before - after)
                for (_, before), (name, after) in zip(counts, counts[1:])]
        first, last = counts[0][1], counts[-1][1]
        return self.df.sparkSession.createDataFrame(
            [*rows, ("total", first, last, first - last)], "step string, before bigint, after bigint, removed bigint")


def deduplicate(df: DataFrame, data_type: str = "unknown", *, order_by: list[str] | None = None,
                remove_exact: bool = True, remove_near: bool = True,
                consistency_check: bool = True, auto_resolve: bool = True,
                keep_strategy: str = "latest",
                similarity_threshold: float = SIMILARITY_THRESHOLD,
                near_columns: list[str] | None = None, store_steps: bool = False,
                near_length: int | None = None, near_unit: str = "character") -> DedupRun:
    """Conflicts, exact duplicates, near-duplicates, then one row per key.

    Conflicting columns are settled before rows are dropped by key: afterwards
    there would be nothing left to compare. `order_by` names the columns that
    number the rows; without it the whole row decides. The steps are counted by the
    jobs that compute them (`DedupRun.report`). `store_steps` keeps the result of
    each step in the scratch folder; the input of the near-duplicate step, which
    reads it twice, is always kept. `near_length` is the number of characters
    that step compares, None for whole rows; `near_unit` is what it counts edits in
    ("character", or "word" for prose).
    """
    named = key_patterns([c for c in df.columns if c not in (order_by or [])], data_type)
    keys = named.strict_columns
    run = DedupRun(df, named)

    def source(table: DataFrame) -> DataFrame:
        """What the next step reads; the first one's rows are the input's."""
        return table if run._watched else run.watch("input", table)

    def step(name: str, result: DataFrame, keep: bool = False) -> None:
        result = run.watch(name, result)
        run.df = store(result, name) if keep or store_steps else result

    if consistency_check:
        settled = run.df
        if keys and named.conflict_columns:
            settled = resolve_conflicts(settled, keys[0], named.conflict_columns)  # keeps every row
        step("inconsistent_duplicates", drop_exact(source(settled), None, order_by),
             keep=remove_near and not remove_exact)
    if remove_exact:
        step("exact_duplicates", drop_exact(source(run.df), keys, order_by), keep=remove_near)
    if remove_near:
        columns = near_columns or named.unique_columns or [
            c for c in flat_columns(run.df) if c not in (order_by or [])]
        if not run._watched:
            run.df = store(source(run.df), "input")
        step("near_duplicates", drop_near_duplicates(
            run.df, columns, order_by, similarity_threshold, near_length, near_unit))
    resolve = {"most_complete": lambda t: keep_most_complete(t, keys, order_by)}
    if named.timestamp_columns:
        resolve["latest"] = lambda t: keep_latest(t, named.timestamp_columns[0], keys, order_by)
    if auto_resolve and keep_strategy in resolve:
        step("auto_resolve", resolve[keep_strategy](source(run.df)))
    if not run._watched:
        run.df = source(run.df)
    return run
