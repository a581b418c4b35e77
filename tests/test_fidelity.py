"""Cells that are easily lost: quotes, microseconds, signed zeros, sparse and very large ids."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiltframe.operators import dedup, lookup, scratch, summaries
from quiltframe.operators.frequency import distinct_counts, value_counts
from quiltframe.plans import templates
from quiltframe.sources import files


def test_csv_written_by_pandas(spark, tmp_path):
    cells = ['say "hi", ok', "two\nlines", "  pad  ", "plain", "tab\there"]
    pd.DataFrame({"id": range(5), "text": cells}).to_csv(tmp_path / "a.csv", index=False)
    back = files.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy("id").collect()
    assert [r.text for r in back] == cells
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame(list(enumerate(cells)), "id int, text string"), out)
    assert sorted(r.text for r in files.read_csv(spark, out, multi_line=True).collect()) == sorted(cells)


def test_microseconds_and_zeros_in_copies(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 1)
    rows = [(1, at, 0.0), (2, at.replace(microsecond=2), 0.0), (3, at, -0.0)]
    df = spark.createDataFrame(rows, "id int, at timestamp, x double")
    marked = {r.id: r.is_duplicate for r in dedup.mark_duplicates(df, ["id"]).collect()}
    assert marked == {1: False, 2: False, 3: True}
    counts = {r.column: r.n_distinct for r in distinct_counts(value_counts(df, ["x", "at"], digest_long=True)).collect()}
    assert counts == {"x": 1, "at": 2}


def test_distinct_instants_in_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(2).select(F.timestamp_seconds(1730610000 + F.col("id") * 3600).alias("at"))
        assert distinct_counts(value_counts(df, ["at"], digest_long=True)).first().n_distinct == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_series_on_sparse_ids(spark):
    dense = spark.range(200).select((F.col("id") * 40).alias("row_id"))
    made = templates.make_rows(dense, "Time Series Data", n=200).orderBy("row_id").collect()
    values = [r.value for r in made]
    for i, row in enumerate(made):
        window = values[max(0, i - 6):i + 1]
        assert row.moving_avg_7d == pytest.approx(sum(window) / len(window))


def test_machine_rows_beyond_int_range(spark):
    name = next(n for n in templates.TEMPLATES if "VM" in n)
    rows = spark.createDataFrame([(500_000_000,)], "row_id bigint")
    stamp = templates.make_rows(rows, name).select(F.col("timestamp").cast("string")).first()[0]
    assert stamp < "2025"


def test_all_columns_by_default(spark):
    df = spark.range(50).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(12)])
    assert summaries.box_summary(df).count() == 12 and summaries.top_variances(df).count() == 12


def test_large_vocabularies_read_the_rows_once(spark, monkeypatch):
    freq = spark.range(400).select(F.col("id").cast("string").alias("value"), (F.col("id") % 7 + 1).alias("n"))
    rows = spark.range(3000).select(F.col("id").alias("row_id"))
    small = lookup.vocabulary(freq)
    placed = rows.withColumn("_at", lookup.position(F.rand(3), small.total)).cache()
    want = sorted(map(tuple, lookup.draw_values(placed, "_at", small, "v").select("row_id", "v").collect()))
    monkeypatch.setattr(lookup, "VOCABULARY_ROWS", 1)
    got = lookup.draw_values(placed, "_at", lookup.vocabulary(freq), "v")
    assert sorted(map(tuple, got.select("row_id", "v").collect())) == want
    many = rows
    for i in range(5):
        at = many.withColumn("_at", lookup.position(F.abs(F.sin(F.col("row_id") + i)) * 0.99, small.total))
        many = lookup.draw_values(at, "_at", lookup.vocabulary(freq), f"v{i}").drop("_at")
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3000") == 1 and many.count() == 3000


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        scratch.scratch_folder(Session())
