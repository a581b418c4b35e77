from pyspark.sql import functions as F

from quiltframe.operators import fit as M
from quiltframe.operators import profile as P
from quiltframe.operators.clean import domain_label


def kinds(df):
    return {p.name: (p.kind, p.role) for p in P.profile_columns(df)}


def test_kinds_and_roles(spark):
    df = spark.createDataFrame(
        [(f"X-{i}", i, f"2024-01-{i + 1:02d}", f"{i}.5", "Yes" if i % 2 else "no", i % 2 == 0,
          f"p{i}@mail.org", "Pune", "9" * 10, "ABCDE1234F", "open", None, i + 110001)
         for i in range(20)],
        "code string, amount int, day string, size string, member string, flag boolean, contact string,"
        "city string, phone string, pan string, order_status string, empty string, pincode int")
    got = kinds(df)
    assert got == {
        "code": ("id", "id"), "amount": ("numeric", "numeric"), "day": ("datetime", "datetime"),
        "size": ("numeric", "numeric"), "member": ("categorical", "closed_categorical"),
        "flag": ("categorical", "closed_categorical"), "contact": ("categorical", "email"),
        "city": ("categorical", "city"), "phone": ("categorical", "phone"),
        "pan": ("categorical", "pan"), "order_status": ("categorical", "closed_categorical"),
        "empty": ("categorical", "closed_categorical"), "pincode": ("categorical", "pincode")}


def test_names_decide_roles():
    s = P._Stats({"n_values": 100, "n_rows": 100, "n_distinct": 100, "avg_length": 12.0, "avg_words": 2.0})
    roles = {"e_mail": "email", "Aadhaar No": "aadhaar", "ifsc": "ifsc", "upi_id": "upi", "gst": "gstin",
             "zip": "pincode", "first_name": "first_name", "surname": "last_name",
             "Customer Name": "person_name", "lead_surgeon": "person_name", "vendor": "closed_categorical",
             "village": "city", "home_state": "state", "nation": "country", "street": "address",
             "mobile": "phone", "hospital": "company", "occupation": "job", "title": "job",
             "medicine": "product", "remark": "closed_categorical"}
    assert {n: P.column_role(n, "categorical", s) for n in roles} == roles
    long = P._Stats({"n_values": 100, "n_rows": 100, "n_distinct": 100, "avg_length": 90.0, "avg_words": 14.0})
    assert P.column_role("remark", "categorical", long) == "text_open"


def test_context(spark):
    cities = spark.createDataFrame([("Pune",), ("Delhi NCR",), ("Oslo",)], "city string")
    assert P.india_context(cities)
    assert not P.india_context(spark.createDataFrame([("Oslo",)], "city string"))
    assert P.india_context(spark.createDataFrame([("x",)], "ifsc_code string"))
    assert not P.india_context(spark.createDataFrame([("x",)], "name string"))
    phones = spark.createDataFrame([("+91 98765 43210",), ("12",)], "phone string")
    assert P.india_phone_style(phones, ["phone"], False)
    assert not P.india_phone_style(phones, [], False)


def test_linked_groups_and_person_columns():
    assert P.linked_groups(["Product_Name", "category", "x", "unit_price"]) == [
        ["Product_Name", "category", "unit_price"]]
    # The first specification takes two of its columns and leaves the product alone.
    assert P.linked_groups(["product", "category", "unit_price"]) == [["category", "unit_price"]]
    assert P.linked_groups(["crop_name", "yield_kg"]) == [["crop_name", "yield_kg"]]
    assert P.linked_groups(["product", "x"]) == []
    profiles = [P.ColumnProfile(n, None, "categorical", r) for n, r in
                (("a", "email"), ("username", "closed_categorical"), ("b", "email"))]
    assert P.person_columns(profiles) == P.PersonColumns(None, None, "username", "a")


def test_id_models(spark):
    def model(values):
        df = spark.createDataFrame([(v,) for v in values], "id string")
        return M.id_model(df.agg(M.id_aggregate(F.col("id")).alias("m")).first()["m"],
                          M._top_prefix(df, "id"))

    assert model(["ORD-001", "ORD-017"]) == M.IdModel("ORD-", 3, 18)
    assert model(["INV-001", "INX-02"]) == M.IdModel("IN", 3, 3)
    assert model(["a b 7", "a b 12", "c d 9", "none"]) == M.IdModel("a b ", 2, 13)
    assert model(["x", "y"]).uuid and model([None]).uuid
    assert model(["N99999999999999999999999", "N1"]).start == 10 ** 23


def test_domains():
    assert domain_label(["Patient_Name", "order_id"]) == "healthcare"
    assert domain_label(["msisdn"]) == "telecom" and domain_label(["x"]) == "unknown"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert [tuple(r)[:4] for r in P.column_stats(df).collect()] == [("a", 0, 0, 0)]
    assert P.table_profile(df).first()["total_records"] == 0
    assert kinds(df)["a"] == ("categorical", "closed_categorical")
