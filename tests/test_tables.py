"""Cleaning, checks, quality and masks on small hand-written tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quiltframe.functions import masks
from quiltframe.functions.text import as_number, as_time, strip
from quiltframe.operators import clean as C
from quiltframe.operators import frequency, privacy, quality as Q, summaries, validate as V
from quiltframe.operators.profile import infer_report_roles


def test_checks(spark):
    with pytest.raises(V.TableError):
        V.require_valid(spark.createDataFrame([], "a int"))
    with pytest.raises(V.TableError):
        V.require_valid(spark.createDataFrame([(float("inf"),)], "a double"))
    with pytest.raises(V.TableError):
        V.require_valid(spark.createDataFrame([(None, None)] * 9 + [(None, 1)], "a int, b int"))
    V.require_valid(spark.createDataFrame([(None, 1)], "a int, b int"))
    assert V.require_sample(spark.createDataFrame([(None, 1), (None, 2)], "a int, b int")) == ["a"]


def test_fills(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", float("nan")), (None, None, 2.0), (4, "a", None),
                                (5, "b", 9.0)], "n int, s string, x double")
    filled = C.fill_mode(C.fill_median(df))
    rows = filled.orderBy("n").collect()
    assert {r["s"] for r in rows} == {"a", "b"} and [r["s"] for r in rows].count("a") == 3
    assert sorted(r["n"] for r in rows) == [1, 2, 3, 4, 5] and dict(filled.dtypes)["n"] == "int"
    assert sorted(r["x"] for r in rows) == [1.0, 2.0, 2.0, 2.0, 9.0]
    half = C.fill_median(spark.createDataFrame([(1,), (2,), (None,)], "n int"))
    assert dict(half.dtypes)["n"] == "double" and sorted(r[0] for r in half.collect()) == [1.0, 1.5, 2.0]
    none = C.fill_mode(spark.createDataFrame([(None,)], "s string"))
    assert none.first()[0] == "Unknown"


def test_text(spark):
    values = ["  x\ty \n", "   ", None, "\x1fz "]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(strip(F.col("s"))).collect()] == [v if v is None else v.strip() for v in values]
    assert [r[0] for r in C.strip_text(df).collect()] == ["x\ty", None, None, "z"]


def test_parsing(spark):
    texts = ["2024-02-30", "2024-2-3", "2024-02-03 04:05:06", "2024-02-03T04:05:06+05:30", "2/3/2024", "3-Feb-2024", "Feb 3, 2024",
             "2024/02/03", "12", "12d", "1e3", "nan", "-.5", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    day = datetime.datetime(2024, 2, 3)
    assert [r[0] for r in df.select(as_time(F.col("s"))).collect()] == [
        None, day, *[datetime.datetime(2024, 2, 3, 4, 5, 6)] * 2, day, day, day, day, *[None] * 6]
    assert [r[0] for r in df.select(as_number(F.col("s"))).collect()] == [None] * 8 + [
        12.0, None, 1000.0, None, -0.5, None]


def test_only_boolean_columns_are_unified(spark):
    df = spark.createDataFrame([("F", "y"), ("M", "no"), ("X", "T")], "gender string, ok string")
    rows = C.prepare_sample(df).collect()
    assert {r["gender"] for r in rows} == {"F", "M", "X"} and {r["ok"] for r in rows} == {"TRUE", "FALSE"}


def test_numbers_named_time_stay(spark):
    df = spark.createDataFrame([(250, "2024-01-01")], "response_time_ms int, start_date string")
    assert dict(C.cast_named_dates(df).dtypes) == {"response_time_ms": "int", "start_date": "timestamp_ntz"}


def test_masks(spark):
    cells = ["ab@c.org", "a@b@c", None, "+1 (555) 123-4567", "12", "4111 1111 1111 1234", "123-45-6789"]
    df = spark.createDataFrame([(v,) for v in cells], "s string")
    def run(mask):
        return [r[0] for r in df.select(mask(F.col("s"))).collect()]
    assert run(masks.mask_email)[:3] == ["a***@c.org", "a@b@c", None]
    assert run(masks.mask_phone)[2:5] == [None, "155***4567", "***"]
    assert run(masks.mask_card)[4:6] == ["12", "****-****-****-1234"]
    assert run(masks.mask_ssn)[4:] == ["12", "***-**-1234", "***-**-6789"]
    text = spark.createDataFrame([("mail a@b.com or call 555-123-4567 from 10.0.0.1",)], "t string")
    assert privacy.redact_text(text).first()[0] == "mail [EMAIL] or call [PHONE] from [IP_ADDRESS]"
    none = spark.createDataFrame([("plain",)], "t string")
    assert privacy.apply_privacy(none).first()[0] == "plain" and privacy.detect_pii(none).isEmpty()


def report(df, **options):
    return Q.quality_report(df, **options).first()


def test_report_of_a_small_table(spark):
    df = spark.createDataFrame([(i, c) for i, c in zip(range(1, 6), "abcde")], "col1 long, col2 string")
    row = report(df)
    assert row["overall_score"] is not None and row["completeness"] == 1.0 and row["uniqueness"] == 1.0


def test_privacy_differs_from_id_uniqueness(spark):
    df = spark.createDataFrame(
        [("C001", "Alice", "NYC"), ("C002", "Bob", "LA"), ("C003", "Carol", "NYC"), ("C004", "Dave", "LA"),
         ("C005", "Eve", "NYC")], "customer_id string, name string, city string")
    row = report(df)
    assert row["id_uniqueness"] == 1.0 and row["privacy_score"] == pytest.approx(0.2)
    assert infer_report_roles(df) == {"customer_id": "id", "name": "person_name", "city": "city"}


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "city string, phone string")
    assert Q.open_diversity(Q.column_uniqueness(df), {"city": "city", "phone": "phone"}).first()[0] == 0.0
    assert Q.open_diversity(Q.column_uniqueness(df), {}).first()[0] == 1.0
    empty = spark.createDataFrame([], "a int")
    assert Q.completeness(empty).first()[0] == 0.0
    assert Q.privacy_score(Q.column_uniqueness(empty)).first()[0] == 0.0


def test_fidelity_corner_cases(spark):
    seed = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "kind string, v double")
    made = spark.createDataFrame([("a", 1.0), ("c", 1.0)], "kind string, v double")
    roles = {"kind": "closed_categorical", "v": "numeric"}
    assert Q.enum_fidelity(made, seed, roles).first()[0] == pytest.approx(0.5)
    assert Q.numeric_fidelity(made, seed, roles).first()[0] == 1.0
    assert Q.numeric_fidelity(made.limit(1), seed, roles).first()[0] == 0.5
    assert Q.enum_fidelity(made, None, roles).first()[0] is None


def test_numbers_are_no_dates(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03")], "n int, d string")
    assert Q.date_diversity(df).first()[0] == 1.0
    assert [r["column"] for r in Q.date_diversity_by_column(df).collect()] == ["d"]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    bins = {r["bin"]: r["n"] for r in summaries.histogram(df, "x").collect()}
    assert bins[0] == 2 and sum(bins.values()) == 2 and len(bins) == 30


def test_most_common_long_texts(spark, monkeypatch):
    """Ties between long texts with one beginning, settled by their heads and then whole."""
    long = "the same beginning of every text, longer than any head " * 4
    texts = [long + x for x in ("b", "a", "b", "a", "c")] + ["zz", "zz", None]
    df = spark.createDataFrame([(t, "y" if t else None, i, None) for i, t in enumerate(texts)],
                               "text string, flag string, id bigint, none string")
    want = {"text": (4, long + "a"), "flag": (1, "y"), "id": (8, "0"), "none": (0, None)}
    assert frequency.most_common_values(df, list(want)) == want
    for few in (1, 2):
        monkeypatch.setattr(frequency, "FEW", few)
        assert frequency.most_common_values(df, list(want)) == want
    filled = C.fill_mode(df.select("text", "none"))
    assert filled.where(F.col("text") == long + "a").count() == 3 and filled.where("none = 'Unknown'").count() == 8
