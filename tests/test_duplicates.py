import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.functions import similarity as S
from quiltframe.functions.similarity import matching_ratio
from quiltframe.operators import dedup as D
from quiltframe.operators import near as N
from quiltframe.operators import shared_grams as G
from quiltframe.operators import skew


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def alike(a, b, threshold=0.85):
    longer = max(len(a), len(b))
    allowed = int(longer * round(1 - threshold, 9) + 1e-9)
    return abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed


def greedy(rows, threshold=0.85, unit="character"):
    """Walk rows (order, gaps, text) as the definition says; order -> leader, survivors."""
    leaders, best, out = [], {}, {}
    for at, gaps, text in rows:
        units = (text.split(" ") if text else []) if unit == "word" else text
        hit = next((l for l, t in leaders if alike(units, t, threshold)), None)
        if hit is None:
            leaders.append((at, units))
            hit = at
            best[at] = (gaps, at)
        elif gaps < best[hit][0]:
            best[hit] = (gaps, at)
        out[at] = hit
    return out, {at for _, at in best.values()}


def squeezed(text):
    return re.sub(r"\s+", " ", text.lower().strip())


def fixture_rows():
    rng = random.Random(5)
    words = ["amber", "basil", "cedar", "delta", "ember", "fjord", "grove", "hazel", "inlet",
             "jolly", "knoll", "lemon", "maple", "north", "ocean", "piano", "quilt", "river"]
    rows, at = [], 0
    for _ in range(12):
        base = " ".join(rng.choice(words) for _ in range(rng.choice([2, 6, 40])))
        for _ in range(rng.choice([1, 2, 9])):
            text = base
            for _ in range(rng.choice([0, 0, 1, 3])):
                i = rng.randrange(len(text))
                text = text[:i] + rng.choice("xyz") + text[i + 1:]
            rows.append((text, rng.choice([None, "filled"])))
    rng.shuffle(rows)
    return [(i, t, extra) for i, (t, extra) in enumerate(rows)]


@pytest.mark.parametrize("hubs, unit", [(1, "character"), (4, "character"), (1, "word"), (4, "word")])
def test_near_duplicates_equal_the_greedy_walk(spark, monkeypatch, hubs, unit):
    monkeypatch.setattr(N, "FIRST_HUBS", hubs)
    rows = fixture_rows()
    want, survivors = greedy([(i, int(e is None), squeezed(t)) for i, t, e in rows], unit=unit)
    df = spark.createDataFrame(rows, "id long, text string, extra string")
    got = {r["id"]: r["leader"] for r in N.near_duplicate_groups(df, ["text"], "id", unit=unit).collect()}
    assert got == want
    kept = N.drop_near_duplicates(df, ["text"], ["id"], unit=unit)
    assert {r["id"] for r in kept.collect()} == survivors


def scattered(unit, every, seed):
    """Texts whose n-th copy has every `every`-th unit changed, shifted: no long run is left whole."""
    rng, rows = random.Random(seed), []
    for _ in range(8):
        base = [rng.choice("abcdefghijklmnop") if unit == "character" else f"w{rng.randrange(400)}"
                for _ in range(rng.choice([20, 47, 150]))]
        for shift in (None, 0, 3, every - 1):
            units = list(base)
            for i in range(shift, len(units), every) if shift is not None else []:
                kind = rng.randrange(3)
                units[i] = "z" if kind == 0 else units[i] + ("" if unit == "character" else " ") + "y" if kind == 1 else ""
            rows.append(("" if unit == "character" else " ").join(u for u in units if u))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("unit, every", [("character", 7), ("character", 12), ("word", 7), ("word", 8)])
def test_scattered_edits_lose_no_pair(spark, unit, every):
    rows = scattered(unit, every, 9)
    want, _ = greedy([(i, 0, t) for i, t in rows], unit=unit)
    assert len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["leader"] for r in N.near_duplicate_groups(df, ["text"], "id", unit=unit).collect()}
    assert got == want


def test_the_first_leader_wins_although_decided_later(spark):
    """Row 3 leaves for row 2 at once; row 1, which it resembles too, becomes a leader by then as well."""
    rows = [(0, "aaaaaaaaaaaaaaaaaaaa"), (1, "aaaaaaaaaaaaaaaabbbb"), (2, "aaaaaaaaaaaaabbbbbbb"), (3, "aaaaaaaaaaaaaabbbbbb")]
    want, _ = greedy([(i, 0, t) for i, t in rows])
    got = {r["id"]: r["leader"] for r in N.near_duplicate_groups(
        spark.createDataFrame(rows, "id long, text string"), ["text"], "id").collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [0.65, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0])
def test_similar_texts_share_a_key_whatever_their_lengths(threshold):
    width, e = S.gram_width(threshold), round(1 - threshold, 9)
    for longer in range(1, 400):
        most = S.edits_allowed(longer, threshold)
        for n in range(longer - most, longer + 1) if most else []:
            shared = longer - width + 1 - width * most
            left = max(1, int(np.ceil(n * (1 - width * e) - (width - 1 + 1e-9))))
            assert shared >= left, (longer, n)
    with pytest.raises(ValueError):
        S.gram_width(0.3)


def test_edit_distance_within_a_band():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(3) for _ in range(rng.randrange(14))]
        b = [rng.randrange(3) for _ in range(rng.randrange(14))]
        most = rng.randrange(8)
        want = distance(a, b)
        assert S.edit_distance(np.array(a, int), np.array(b, int), most) == (want if want <= most else None), (a, b, most)


def test_near_duplicates_without_order_column(spark):
    df = spark.createDataFrame([("north river maple grove", None), ("north river maple grovx", 1.0),
                                ("piano", 2.0)], "text string, v double")
    assert {tuple(r) for r in N.drop_near_duplicates(df, ["text"]).collect()} == {
        ("north river maple grovx", 1.0), ("piano", 2.0)}


def test_near_duplicates_with_text_keys(spark):
    rows = [(f"k{i:04d}", t) for i, t, _ in fixture_rows()]
    want, _ = greedy([(k, 0, squeezed(t)) for k, t in rows])
    df = spark.createDataFrame(rows, "id string, text string")
    assert {r["id"]: r["leader"] for r in N.near_duplicate_groups(df, ["text"], "id").collect()} == want


def test_crowded_band_of_unlike_rows(spark):
    """Short rows that share bands but are all unlike: nothing is dropped or capped."""
    df = spark.range(300).select("id", F.concat(F.lit("item "), F.sha2(F.col("id").cast("string"), 256)
                                                .substr(1, 12), F.lit(" of lot")).alias("text"))
    rows = [(r["id"], 0, r["text"]) for r in df.orderBy("id").collect()]
    want, _ = greedy(rows)
    got = {r["id"]: r["leader"] for r in N.near_duplicate_groups(df, ["text"], "id").collect()}
    assert got == want


def test_similar_keys_form_one_group(spark, monkeypatch):
    """Consecutive numbered keys are similar: one hot group, found without all pairs."""
    monkeypatch.setattr(skew, "SMALL_TABLE", 10)
    df = spark.range(400).select("id", F.format_string("txn20250101%04d", "id").alias("text"))
    want, _ = greedy([(i, 0, f"txn20250101{i:04d}") for i in range(400)])
    got = {r["id"]: r["leader"] for r in N.near_duplicate_groups(df, ["text"], "id").collect()}
    assert got == want


def test_matching_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("", "a"), ("same", "same"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(matching_ratio("a", "b")).collect()]
    assert got == [0.75, 1.0, 0.0, 1.0, None]


def test_hot_keys_join_like_any_other(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1200, 0).otherwise(
        F.col("id")).alias("k"))
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    plain = {tuple(r) for r in skew.join_by_key(rows, per_key, ["k"], "n").collect()}
    monkeypatch.setattr(skew, "SMALL_TABLE", 10)
    split = skew.join_by_key(rows, per_key, ["k"], "n")
    assert "_part" in split._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in split.collect()} == plain and len(plain) == 3000


def test_equal_rows_of_a_hot_key_spread(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("if(id < 2500, 'hot', concat('k', id % 50)) AS k", "1 AS v")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.upper("k"))
    monkeypatch.setattr(skew, "SMALL_TABLE", 10)
    found = skew.join_by_key(rows, per_key, ["k"], "n", repeated=True)
    assert sorted(found.columns) == ["k", "name", "v"]
    counts = {r.k: (r.name, r["count"]) for r in found.groupBy("k", "name").count().collect()}
    assert counts == {r.k: (r.name, r.n) for r in per_key.collect()}
    large = per_key.where("n > 100").selectExpr("k", "bigint(40) AS _parts")
    shares = skew._dealt(rows, large, ["k"]).where("k = 'hot'").groupBy("_part").agg(F.sum("_copies").alias("n"))
    assert sorted(r.n for r in shares.collect()) == [62] * 20 + [63] * 20


def test_hot_key_conflicts(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_TABLE", 10)
    rows = [(0, "b")] * 500 + [(0, "a")] * 499 + [(i, "z") for i in range(1, 900)]
    df = spark.createDataFrame(rows, "k int, v string")
    got = D.resolve_conflicts(df, "k", ["v"])
    assert got.where("k = 0 and v = 'b'").count() == 999 and got.count() == len(rows)


def test_conflicts_leave_null_keys_and_skip_null_values(spark):
    df = spark.createDataFrame([(None, "p"), (None, "q"), (1, None), (1, None), (1, "x"), (2, None)],
                               "k int, v string")
    assert sorted(map(str, (tuple(r) for r in D.resolve_conflicts(df, "k", ["v"]).collect()))) == sorted(
        map(str, [(None, "p"), (None, "q"), (1, "x"), (1, "x"), (1, "x"), (2, None)]))


def test_key_patterns():
    columns = ["Transaction_ID", "Customer_ID", "Product", "Order_Date", "Quantity"]
    named = D.key_patterns(columns, "Sales Transactions")
    assert named.strict_columns == ["Transaction_ID"]
    assert named.unique_columns == ["Transaction_ID", "Customer_ID"]
    assert named.conflict_columns == ["Product", "Quantity"]
    assert named.timestamp_columns == ["Order_Date"]
    assert D.key_patterns(["toll_amount", "vehicle_number"]).strict_columns == ["vehicle_number"]
    assert D.key_patterns(["a"], "unknown").strict_columns == []


def test_null_keys_count_as_equal(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "k", "c")], "n int, k string, v string")
    assert {r["v"] for r in D.drop_exact(df, ["k"], ["n"]).collect()} == {"b", "c"}


def test_most_complete_without_key_compares_whole_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, None)], "k int, v string")
    assert D.keep_most_complete(df).count() == 3


def test_marks(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "n int, v string, w int")
    def marks(keep):
        return [r["is_duplicate"] for r in D.mark_duplicates(df, ["n"], keep).orderBy("n").collect()]
    assert marks("first") == [False, True, False]
    assert marks("last") == [True, False, False]
    assert marks(False) == [True, True, False]


def test_full_run_with_strategies(spark):
    rows = [(0, "C1", "Lamp", None, "2024-01-01"), (1, "C1", "Lamp", 5, "2024-03-01"),
            (2, "C1", "Desk", 5, "2024-02-01"), (3, "C2", "Sofa", 7, None)]
    df = spark.createDataFrame(rows, "n int, transaction_id string, product string, v int, created_at string")
    latest = D.deduplicate(df, "sales", order_by=["n"], remove_exact=False, remove_near=False)
    assert {(r["n"], r["product"]) for r in latest.df.collect()} == {(1, "Lamp"), (3, "Sofa")}
    whole = D.deduplicate(df, "sales", order_by=["n"], remove_near=False, keep_strategy="most_complete")
    report = {r["step"]: r["removed"] for r in whole.report().collect()}
    assert report == {"inconsistent_duplicates": 0, "exact_duplicates": 2, "auto_resolve": 0, "total": 2}


def test_report_counts_in_the_jobs_that_compute_the_steps(spark, tmp_path):
    rows = [(i, f"C{i % 40}", f"P{i % 3}", i % 7) for i in range(400)]
    spark.createDataFrame(rows, "n int, transaction_id string, product string, v int").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    run = D.deduplicate(table, "sales", order_by=["n"], remove_near=False)
    result = run.df.count()
    assert [tuple(r) for r in run.report().collect()] == [
        ("inconsistent_duplicates", 400, 280, 120), ("exact_duplicates", 280, 40, 240), ("total", 400, 40, 360)]
    assert result == 40
    # The plan holds its counters, and reads the table as often as the result alone does.
    plan = run.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 3
    near = D.deduplicate(table, "sales", order_by=["n"], consistency_check=False, remove_exact=False)
    assert {r.step for r in near.report().collect()} == {"near_duplicates", "total"} and near.counts()[0] == ("input", 400)
    empty = D.deduplicate(table.limit(0), "sales", order_by=["n"], remove_near=False)
    assert [tuple(r) for r in empty.report().collect()][-1] == ("total", 0, 0, 0)
    none = D.deduplicate(table, remove_exact=False, remove_near=False, consistency_check=False, auto_resolve=False)
    assert [tuple(r) for r in none.report().collect()] == [("total", 400, 400, 0)]


def test_numbers_in_planes():
    for values in ([], [0, 0], [5, 255, 256], [2 ** 48 - 1, 0, 2 ** 33], [2 ** 64 - 1]):
        values = np.array(values, np.uint64)
        assert list(G.unplaned(G.planes(values))) == list(values)
        assert list(G._risen(G._rising(np.sort(values)))) == sorted(values)


@pytest.mark.parametrize("unit,block", [("word", 300), ("character", 1000), ("word", 10 ** 6)])
def test_rarest_shared_grams_by_brute_force(spark, unit, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(i * 10 - 400, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(120)]
    rows += [(5001, rows[3][1]), (5002, "a b"), (5003, "")]
    size = (lambda t: len(t)) if unit == "character" else (lambda t: len(t.split(" ")) if t else 0)
    grams = {at: [int(g) >> 16 for g in S.gram_hashes(t, unit, 3).view(np.uint64)] for at, t in rows}
    df = Counter(g for own in grams.values() for g in own)
    want = set()
    for at, text in rows:
        if grams[at]:
            needed = S.keys_needed(np.array([size(text)]), 3, 0.85)[0]
            kept = [g for n, g in sorted((df[g], g) for g in grams[at])[:needed] if n > 1]
            want |= {(at, size(text), g, len(kept)) for g in kept}
    texts = spark.createDataFrame([(at, size(t), t) for at, t in rows], "at long, len int, text string").repartition(5)
    got = G.rarest_shared_grams(texts, unit, 3, 0.85, block_grams=block)
    assert got.dtypes == [("at", "bigint"), ("len", "int"), ("key", "bigint"), ("n_keys", "bigint")]
    assert {tuple(r) for r in got.collect()} == want and want


def test_few_bytes_of_a_gram_are_sent(spark):
    """A gram took some 35 bytes in three shuffles."""
    texts = spark.range(200).select(F.col("id").alias("at"), F.lit(400).alias("len"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(400)), lambda i: F.hash("id", i).cast("string"))).alias("text"))
    sent = texts.coalesce(1).mapInPandas(G._packed("word", 3, 8, 10 ** 6), G.PACKET).agg(
        F.sum(F.length("grams") + F.length("texts") + F.length("head"))).first()[0]
    assert sent <= 8 * 200 * 398
