import random
from decimal import Context, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quiltframe.operators import order_stats
from quiltframe.operators.clean import fill_median
from quiltframe.operators.order_stats import exact_quantiles
from quiltframe.operators.ordered import dense_position, rolling_mean, running_sum

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


def test_positions_of_large_tables(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", F.when(F.col("user_id") > 3, F.col("user_id")).otherwise(0).alias("user_id"), "ts")
    for series in ([], ["user_id"]):
        small = dense_position(events, ["ts", "event_id"], series)
        large = dense_position(events, ["ts", "event_id"], series, small=10, partitions=7)
        assert large.select(small.columns).exceptAll(small).count() == 0
        assert large.count() == events.count()


@pytest.mark.parametrize("name", ["_at", "_part", "_shift", "place"])
def test_positions_under_any_name(spark, name):
    rows = spark.range(300).select((F.col("id") * 37 % 300).alias("v"))
    large = dense_position(rows, ["v"], name=name, small=10, partitions=5)
    assert large.columns == ["v", name]
    assert all(r["v"] == r[name] for r in large.collect()) and large.count() == 300


@pytest.mark.parametrize("block", [5, 40, 10_000])
def test_blocks_do_not_show(spark, block):
    rows = spark.range(500).withColumn("v", ((F.col("id") * 37) % 101).cast("double"))
    means = rolling_mean(rows, F.col("v"), "id", {"m7": 7, "m30": 30}, block=block)
    sums = running_sum(means, F.col("v"), "id", "total", block=block)
    got = sums.orderBy("id").collect()
    values = [(i * 37) % 101 for i in range(500)]
    assert len(got) == 500
    for i, r in enumerate(got):
        for name, k in (("m7", 7), ("m30", 30)):
            part = values[max(0, i - k + 1):i + 1]
            assert r[name] == pytest.approx(sum(part) / len(part))
        assert r["total"] == pytest.approx(sum(values[:i + 1]))


def test_quantiles_by_selection(spark):
    df = spark.read.parquet(LINEITEM).withColumn(
        "flat", F.when(F.col("l_quantity") < 40, 1.0).otherwise(F.col("l_extendedprice")))
    names, probs = ["l_quantity", "l_extendedprice", "l_linenumber", "flat"], [0.0, 0.25, 0.5, 0.75, 1.0]

    def table(small):
        return {(r["column"], r["p"]): r["value"]
                for r in exact_quantiles(df, names, probs, small=small).collect()}

    assert table(50) == pytest.approx(table(10 ** 6))


def test_quantiles_of_gaps(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (4.0, None)], "a double, b double")
    got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {("a", 0.5): 2.5, ("b", 0.5): None}


@pytest.mark.parametrize("small", [1, 1000])
def test_quantiles_with_infinities(spark, small):
    inf = float("inf")
    tables = {"a": [1.0, inf, inf, inf], "b": [-inf, -inf, 2.0, inf], "c": [-inf, 1.0, 3.0, 4.0], "d": [inf] * 4}
    df = spark.createDataFrame(list(zip(*tables.values())), ", ".join(f"{n} double" for n in tables))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, list(tables), probs, small=small).collect()}
    assert [got["a", p] for p in probs] == [1.0, inf, inf, inf, inf]
    assert [got["b", p] for p in probs] == [-inf, -inf, -inf, inf, inf]
    assert [got["c", p] for p in probs] == [-inf, -inf, 2.0, 3.25, 4.0]
    assert [got["d", p] for p in probs] == [inf] * 5


def test_selection_in_the_columns_own_types(spark):
    rng = random.Random(7)
    kinds = {"a bigint": [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(300)],
             "b bigint": [2 ** 53 + rng.randrange(9) for _ in range(300)],
             "c double": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-323, 308) for _ in range(297)]
             + [5e-324, -5e-324, -0.0],
             "d decimal(18,4)": [Decimal(rng.randrange(-10 ** 18, 10 ** 18)).scaleb(-4) for _ in range(300)],
             "e decimal(36,18)": [Decimal(rng.randrange(-10 ** 36, 10 ** 36)).scaleb(-18, Context(prec=60)) for _ in range(300)],
             "f decimal(38,4)": [Decimal(rng.randrange(-10 ** 38, 10 ** 38)).scaleb(-4, Context(prec=60)) for _ in range(300)],
             "g tinyint": [rng.randrange(-128, 128) for _ in range(300)], "h float": [0.5] * 300}
    df = spark.createDataFrame(list(zip(*kinds.values())), ", ".join(kinds))
    names = [k.split()[0] for k in kinds]
    ranks = {n: [0, 1, 149, 150, 298, 299] for n in names}
    found = order_stats._values_at_ranks(df, ranks)
    for name, values in zip(names, kinds.values()):
        assert [found[name, r] for r in ranks[name]] == [sorted(values)[r] for r in ranks[name]], name
    tables = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, names, [0.5]).collect()}
    middle = sorted(kinds["a bigint"])[149:151]
    assert tables["a", 0.5] == float(Fraction(sum(middle), 2))


def test_selection_needs_four_scans_at_most(spark, monkeypatch):
    calls, plain = [], order_stats._counted
    monkeypatch.setattr(order_stats, "_counted", lambda *a: calls.append(1) or plain(*a))
    df = spark.range(2000).selectExpr("cast(pow(id, 5) + rand(3) as double) AS x", "xxhash64(id) AS y", "id % 7 AS z")
    order_stats._values_at_ranks(df, {"x": [3, 999], "y": [0, 1000], "z": [1000]})
    assert len(calls) <= 4


def test_medians_fill_without_rounding(spark):
    big, step = 2 ** 60 + 1, Decimal("0.01")
    df = spark.createDataFrame([(big, big, step), (big + 2, big + 1, step * 2), (None, None, None)],
                               "whole bigint, half bigint, cents decimal(10,2)")
    filled = fill_median(df)
    assert [f.dataType.simpleString() for f in filled.schema] == ["bigint", "decimal(20,1)", "decimal(11,3)"]
    sums = filled.agg({"whole": "sum", "half": "sum", "cents": "sum"}).first()
    assert sums["sum(half)"] == Decimal(3 * (2 * big + 1)) / 2
    assert sums["sum(whole)"] == 3 * big + 3 and sums["sum(cents)"] == Decimal("0.045")
