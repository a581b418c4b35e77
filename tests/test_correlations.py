"""Correlations of wide tables against pandas and against the narrow form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiltframe.operators import cross
from quiltframe.operators.cross import cross_products
from quiltframe.operators.fit import correlations


def wide_table(spark, columns, rows=400):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (rows, 7))
    values = base @ rng.normal(0, 1, (7, columns)) + rng.normal(0, 0.5, (rows, columns)) + 1e6 * rng.random(columns)
    values[rng.random((rows, columns)) < 0.2] = np.nan
    values[:, 3] = 5.0                       # does not vary
    values[:, 4] = np.nan                    # all missing
    values[1:, 5] = np.nan                   # one value
    names = [f"c {i}" for i in range(columns)]
    frame = pd.DataFrame(values, columns=names)
    return spark.createDataFrame(frame).repartition(5), frame


def test_wide_correlations_equal_the_narrow_ones(spark):
    table, frame = wide_table(spark, 40)     # 820 pairs: cross products
    got = {(r.a, r.b): r.r for r in correlations(table, list(frame.columns)).collect()}
    assert len(got) == 1600
    few = list(frame.columns)[3:7]           # ten pairs: built-in aggregates
    narrow = {(r.a, r.b): r.r for r in correlations(table, few).collect()}
    want = frame.corr(min_periods=2).to_numpy()
    for (a, b), r in got.items():
        w = want[frame.columns.get_loc(a), frame.columns.get_loc(b)]
        assert (r is None) == bool(np.isnan(w)), (a, b, r, w)
        assert r is None or r == pytest.approx(w, abs=1e-7)
        assert (a, b) not in narrow or (r is None and narrow[a, b] is None) or r == pytest.approx(narrow[a, b], abs=1e-7)


def test_a_thousand_columns_take_one_scan(spark, tmp_path):
    table, frame = wide_table(spark, 1000, 120)
    table.write.parquet(str(tmp_path / "wide"))
    read = spark.read.parquet(str(tmp_path / "wide"))
    found = cross_products(read.select(*[F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(frame.columns)]),
                           list(frame.columns))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    sample = {(r.a, r.b): r.r for r in found.where("a = 'c 10'").collect()}
    assert len(sample) == 990 and sample["c 10", "c 900"] == pytest.approx(frame["c 10"].corr(frame["c 900"]), abs=1e-7)


def test_strips_and_infinities(spark, monkeypatch):
    monkeypatch.setattr(cross, "STATE_MB", 0)  # a scan per column
    table = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, float("inf")), (4.0, 5.0, None)], "x double, y double, z double")
    got = {(r.a, r.b): r.r for r in cross_products(table, ["x", "y", "z"]).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 5])[0, 1]) and got["x", "z"] is None
    assert cross_products(table.limit(0), ["x", "y", "z"]).where("r IS NULL").count() == 6
