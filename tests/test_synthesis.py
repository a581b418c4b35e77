import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from quiltframe.functions import formats as Fm
from quiltframe.operators import lookup as L
from quiltframe.operators import synthesize as S
from quiltframe.operators.fit import fit
from quiltframe.operators.validate import TableError
from quiltframe.plans import templates as T
from quiltframe.plans.template_specs import TEMPLATES

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def test_personal_and_sales_templates(spark):
    people = T.generate_template(spark, "Personal/Customer Data", 10)
    assert people.count() == 10 and len(people.columns) == 19
    assert "total" in T.generate_template(spark, "Sales Transactions", 10).columns


@pytest.mark.parametrize("template", list(TEMPLATES))
def test_templates_do_not_depend_on_partitions(spark, template):
    one = T.make_rows(T.row_source(spark, 300, 1), template, n=300)
    many = T.make_rows(T.row_source(spark, 300, 16), template, n=300)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_template_ranges(spark):
    sales = T.generate_template(spark, "Sales Transactions", 3000)
    row = sales.agg(F.min("quantity"), F.max("quantity"), F.avg(F.col("returned").cast("int")),
                    F.sum((F.col("total") != F.col("unit_price") * F.col("quantity")).cast("int")),
                    F.max(F.when(F.col("product") == "Mouse", F.col("unit_price"))),
                    F.min(F.when(F.col("product") == "Laptop", F.col("unit_price")))).first()
    assert row[0] == 1 and row[1] == 10 and 0.03 < row[2] < 0.07 and row[3] == 0
    assert row[4] < 300 and row[5] >= 500
    toll = T.generate_template(spark, "Toll Plaza Data", 3000)
    assert toll.groupBy("Vehicle_Number").agg(F.count_distinct("Vehicle_Type").alias("k")).where("k > 1").isEmpty()
    assert toll.select("Transaction_ID").distinct().count() == 3000
    assert 0.03 < toll.where("Payment_Status = 'Failed'").count() / 3000 < 0.07
    iot = T.generate_template(spark, "IoT Sensor Data", 2000)
    assert iot.where("device_type = 'pressure' and (value < 950 or value > 1030 or unit <> 'hPa')").isEmpty()


def test_cleaned_template(spark):
    made = T.generate_template(spark, "Employee Records", 40, cleaned=True)
    assert made.count() == 40 and "row_id" not in made.columns
    assert dict(made.dtypes)["hire_date"] == "timestamp_ntz"
    with pytest.raises(ValueError):
        T.generate_template(spark, "No Such Data", 5)
    with pytest.raises(TableError):
        T.generate_template(spark, "Employee Records", 0)


def test_small_sample(spark):
    sample = spark.createDataFrame([(i, c) for i, c in zip(range(1, 6), "abcde")], "col1 long, col2 string")
    made = S.generate_custom(sample, 10)
    assert made.count() == 10 and made.columns == ["col1", "col2"]
    assert {r["col2"] for r in made.collect()} <= set("abcde")


def test_numbers_default_to_integers(spark):
    sample = spark.createDataFrame([(1, 10.5), (2, 11.2), (1, 9.8), (2, 10.1), (3, 11.0)],
                                   "quantity long, score double")
    for r in S.generate_custom(sample, 20).collect():
        assert float(r["quantity"]).is_integer() and float(r["score"]).is_integer()


def test_prices_have_two_decimals(spark):
    sample = spark.createDataFrame(
        [(12.99, 1), (267.9046, 2), (148.2547, 1), (47.6817, 1), (75.3189, 2)],
        "unit_price_usd double, quantity long")
    for r in S.generate_custom(sample, 20).collect():
        assert abs(r[0] - round(r[0], 2)) < 1e-9 and float(r[1]).is_integer()


def test_one_row_sample(spark):
    made = S.generate_custom(spark.createDataFrame([(7, "x")], "n int, v string"), 5)
    assert {r["v"] for r in made.collect()} == {"x"} and made.count() == 5
    with pytest.raises(TableError):
        S.generate_from_sample(spark.createDataFrame([(7, "x")], "n int, v string"), 5)


def test_seed_and_partitions(spark):
    orders = spark.read.parquet(ORDERS)
    a, b, c = (sorted(map(str, S.generate_from_sample(orders, 500, seed=s, partitions=p).collect()))
               for s, p in ((1, 1), (1, 13), (2, 4)))
    assert a == b != c and len(a) == 500


def test_invariants(spark):
    orders = spark.read.parquet(ORDERS)
    made = S.generate_from_sample(orders, 2000)
    assert made.columns == orders.columns and made.count() == 2000
    bounds = [f(c) for c in ("o_totalprice", "o_orderdate") for f in (F.min, F.max)]
    lo, hi, first, last = orders.agg(*bounds).first()
    got = made.agg(*bounds).first()
    assert lo <= got[0] and got[1] <= hi and first <= got[2] and got[3] <= last
    known = {r[0] for r in orders.select("o_orderpriority").distinct().collect()}
    assert {r[0] for r in made.select("o_orderpriority").distinct().collect()} <= known


def test_correlation_is_imposed(spark):
    base = spark.range(4000).select((F.col("id") % 97).cast("double").alias("x"))
    sample = base.withColumn("y", F.col("x") * 2 + (F.col("x") * 13) % 11)
    r = sample.agg(F.corr("x", "y")).first()[0]
    made = S.generate_custom(sample, 4000)
    assert abs(made.agg(F.corr("x", "y")).first()[0] - r) < 0.15
    free = S.generate_custom(sample, 4000, preserve_correlations=False)
    assert abs(free.agg(F.corr("x", "y")).first()[0]) < 0.1


def test_large_vocabularies_draw_the_same_values(spark, monkeypatch):
    freq = spark.createDataFrame([(f"v{i:03d}", 4000 if i == 5 else 1 + i % 3) for i in range(300)],
                                 "value string, n long")
    vocab = L.vocabulary(freq)
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % vocab.total).alias("at"))
    small = {tuple(r) for r in L.draw_values(rows, "at", vocab, "v").select("id", "v").collect()}
    monkeypatch.setattr(L, "VOCABULARY_ROWS", 10)
    monkeypatch.setattr(L, "HOT_VALUES", 50)
    large = {tuple(r) for r in L.draw_values(rows, "at", vocab, "v").select("id", "v").collect()}
    assert large == small and len(small) == 5000


def test_vocabularies_numbered_by_ranges_draw_the_same_values(spark, monkeypatch):
    freq = spark.createDataFrame([(i * 0.5, 3000 if i == 7 else 1 + i % 3) for i in range(400)], "value double, n long")
    vocab = L.vocabulary(freq)
    rows = spark.range(3000).select("id", (F.col("id") * 7919 % vocab.total).alias("at"))
    small = {tuple(r) for r in L.draw_values(rows, "at", vocab, "v").select("id", "v").collect()}
    monkeypatch.setattr(L, "VOCABULARY_ROWS", 10)
    monkeypatch.setattr(L, "dense_position", partial(L.dense_position, small=10, partitions=6))
    large = {tuple(r) for r in L.draw_values(rows, "at", vocab, "v").select("id", "v").collect()}
    assert large == small and len(small) == 3000


@pytest.mark.parametrize("make", [
    lambda df: S.generate_from_sample(df, 400),
    lambda df: S.synthesize(fit(df.select("o_custkey", "o_totalprice")), T.rows_of(df, "o_orderkey"))])
def test_tables_of_large_vocabularies_are_the_same(spark, monkeypatch, make):
    rows = [(i, i * 7 % 90, "OF"[i % 2], i * 31 % 1009 / 4) for i in range(400)]
    sample = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    small = sorted(map(str, make(sample).collect()))
    monkeypatch.setattr(L, "VOCABULARY_ROWS", 10)
    monkeypatch.setattr(L, "dense_position", partial(L.dense_position, small=10, partitions=6))
    assert sorted(map(str, make(sample).collect())) == small and len(small) == 400


def test_texts_of_a_large_vocabulary_are_the_same(spark, monkeypatch):
    sample = spark.range(120).select(F.concat(F.lit("note "), (F.col("id") * 7 % 97).cast("string"), F.lit(
        " was sent to the customer by the branch")).alias("notes"))
    small = sorted(map(str, S.synthesize(fit(sample), T.row_source(spark, 120)).collect()))
    monkeypatch.setattr(L, "VOCABULARY_ROWS", 10)
    monkeypatch.setattr(L, "dense_position", partial(L.dense_position, small=10, partitions=4))
    assert sorted(map(str, S.synthesize(fit(sample), T.row_source(spark, 120)).collect())) == small and len(small) == 120


def test_only_positions_travel_through_the_lookups(spark, monkeypatch):
    seen, plain = [], S.draw_values
    monkeypatch.setattr(S, "draw_values", lambda rows, *a: seen.append(rows.columns) or plain(rows, *a))
    sample = spark.range(50).select((F.col("id") * 7 % 41).alias("a_price"), (F.col("id") / 4).alias("b_price"))
    S.synthesize(fit(sample), T.row_source(spark, 50), preserve_correlations=False)
    assert len(seen) == 2 and not any(c.startswith("_draw_") for columns in seen for c in columns)


def test_unique_formats(spark):
    patterns = {Fm.AADHAAR: r"[2-9]\d{11}", Fm.PAN: r"[A-Z]{5}\d{4}[A-Z]",
                Fm.IFSC: r"(SBIN|HDFC|ICIC|AXIS|PUNB|UBIN|CNRB|KKBK)0\d{6}"}
    for fmt, pattern in patterns.items():
        values = [r[0] for r in spark.range(5000).select(fmt.text(F.col("id"), 42)).collect()]
        assert len(set(values)) == 5000 and all(re.fullmatch(pattern, v) for v in values)
        fmt.check(fmt.size)
        with pytest.raises(ValueError):
            fmt.check(fmt.size + 1)
    assert Fm.IFSC.size == 8_000_000 and Fm.AADHAAR.size == 8 * 10 ** 11


def test_domain_overflow_is_an_error(spark):
    sample = spark.createDataFrame([("SBIN0000001",), ("HDFC0000002",)], "ifsc string")
    with pytest.raises(ValueError):
        S.synthesize(fit(sample), spark.range(0, 9_000_000, 4_000_000).withColumnRenamed("id", "row_id"))


def test_zero_span_dates(spark):
    sample = spark.createDataFrame([("2024-05-01",)] * 6, "day string")
    assert {str(r[0]) for r in S.generate_custom(sample, 5).collect()} == {"2024-05-01 00:00:00"}
    times = spark.createDataFrame([("2024-05-01 10:00:00",), ("2024-05-01 10:00:09",)], "at string")
    got = {str(r[0]) for r in S.generate_custom(times, 50).collect()}
    assert len(got) > 3 and all("2024-05-01 10:00:0" in t for t in got)


def test_ids_continue_the_sample(spark):
    sample = spark.createDataFrame([(f"ORD-{i:03d}",) for i in range(1, 30)], "order_id string")
    got = {r[0] for r in S.generate_custom(sample, 5).collect()}
    assert got == {f"ORD-{i:03d}" for i in range(30, 35)}


def test_checks_find_faults(spark):
    sample = spark.createDataFrame([(f"A{i}", "long label" if i % 2 else "other label", f"2024-01-{i + 1:02d}")
                                    for i in range(20)], "row_code string, status string, day string")
    model = fit(sample)
    bad = spark.createDataFrame([("A1", "new", "2024-01-01"), ("A1", "new", "2024-01-01")], sample.schema)
    found = {(r["check"], r["column"]): r["severity"] for r in S.check_synthesis(bad, model).collect()}
    assert found == {("id_collisions", "row_code"): "error", ("invented_labels", "status"): "error",
                     ("short_labels", "status"): "error", ("date_diversity", "day"): "error"}


def test_times_do_not_depend_on_the_session_zone(spark):
    orders = spark.read.parquet(ORDERS).select("o_orderdate")
    def bounds():
        made = S.generate_custom(orders, 200)
        return [str(r) for r in made.select(F.col("o_orderdate").cast("string")).collect()]
    here = bounds()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert bounds() == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_single_values_of_any_type(spark):
    sample = spark.createDataFrame([("Lamp", "Home", 2.5, "2024-05-01 10:00:00", "same")] * 3,
                                   "product_name string, category string, unit_price double, at string, tag string")
    rows = {tuple(map(str, r)) for r in S.generate_custom(sample, 4).collect()}
    assert rows == {("Lamp", "Home", "2.5", "2024-05-01 10:00:00", "same")}
