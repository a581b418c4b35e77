"""Decontamination and Order MinHash against plain Python."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quiltframe.llm import decontaminate as D, order_minhash as O


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 60))) for _ in range(12)] + ["only three words", None, ""]
    texts = {}
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([0, 5, 200, 1500]))]
        if i < 30:  # an item, with every 12th word replaced in half of them
            item = items[i % 12].upper().split()
            item = [w if i % 2 or j % 12 != 5 else "changed" for j, w in enumerate(item)]
            at = rng.randint(0, len(body))
            body[at:at] = item
        texts[i] = " ".join(body)
    texts |= {100: None, 101: "", 102: " \n ", 103: "so  Only three\twords here", 104: "only three other words"}
    docs = spark.createDataFrame([*texts.items(), (None, texts[3]), (3, texts[3])], "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id bigint, text string")
    return docs.withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(1)), bench.withColumn("doc_id", F.lit(1)), texts


def test_planted_passages(world):
    docs, bench, texts = world
    found = D.overlaps(docs.repartition(3), bench).collect()
    assert {r.doc_id for r in found} == {*range(30), 103, None}
    for r in found:
        if r.doc_id is not None and r.doc_id < 30:
            assert r.item_id == r.doc_id % 12 and r.matched <= r.end - r.start and r.matched >= 10
    left = D.decontaminate(docs, bench)
    assert {r.doc_id for r in left.collect()} == {*range(30, 60), 100, 101, 102, 104} and left.columns == docs.columns


def test_shuffled_joins_agree(world, monkeypatch):
    docs, bench, _ = world
    want = sorted(map(str, D.overlaps(docs, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(D, "BROADCAST_DOCS", 0)
    monkeypatch.setattr(D, "BLOCK", 7)
    assert sorted(map(str, D.overlaps(docs, bench).collect())) == want


def test_empty_tables(world):
    docs, bench, _ = world
    assert D.overlaps(docs.limit(0), bench).count() == 0
    assert D.overlaps(docs, bench.where("text = 'x'")).count() == 0


def pairs(docs):
    return {r.doc_id: r for r in O.edited_pairs(docs).collect()}


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(O, "DOCS_PER_BLOCK", 4)
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["é", "the", "of"]) + str(rng.randint(0, 900)) for _ in range(rng.choice([0, 3, 90, 400])))
             for i in range(0, 80, 2)}
    texts |= {81: None, 83: texts[20], 85: texts[20], 87: "x" * 5000, 89: "\U0001F600" * 9}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("next_text", F.lit("clash"))
    got = pairs(docs.repartition(5))
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, after = texts[i] or "", texts[following] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if len(text) > 1000:
            assert got[i].near_edited > 0.1 or after == text
    assert got[83].fingerprint == got[20].fingerprint == got[85].fingerprint and got[83].near_next == 1
    assert got[81].fingerprint == ""


def test_order_matters_and_repeats_count(spark):
    words = [f"a{i}" for i in range(300)]
    turned = words[150:] + words[:150]
    texts = [" ".join(words), " ".join(words[:290] + ["new"] * 10), " ".join(turned), "to to to to", "to to to"]
    marks = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        O.fingerprint(F.col("t")).alias("m")).collect()]

    def like(a, b):
        return len(set(marks[a]) & set(marks[b])) / 32

    assert like(0, 1) > 0.7 > like(0, 2) and marks[3] != marks[4]
    assert all(len(m) <= 32 for m in marks)


def test_few_rows(spark):
    docs = spark.createDataFrame([(4, "one text of its own")], "doc_id bigint, text string")
    row = O.edited_pairs(docs).first()
    assert row.near_next == 1 and row.n_chars == 19
    assert O.edited_pairs(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (4, "c d"), (4, "c d"), (4, "e f")], "doc_id bigint, text string")
    assert O.edited_pairs(twice).count() == 4


def brute_stretches(same, least):
    spans = [(i, j, sum(same[i:j])) for i in range(len(same)) for j in range(i + least, len(same) + 1)
             if 10 * sum(same[i:j]) >= 8 * (j - i)]
    return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))


def test_every_maximal_stretch(spark):
    rng = random.Random(3)
    rows = [([rng.random() < share for _ in range(rng.randint(1, 60))], rng.choice([3, 10]))
            for share in (0.2, 0.6, 0.75, 0.8, 0.9, 1.0) for _ in range(40)]
    table = spark.createDataFrame(rows, "same array<boolean>, least int")
    found = table.select("same", "least", D._stretches(F.col("same"), F.col("least"), 0.8).alias("s")).collect()
    for r in found:
        assert sorted(map(tuple, r.s)) == brute_stretches(r.same, r.least)


def test_exact_words_beside_light_matches(spark):
    item = [f"w{i}" for i in range(300)]
    light = [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(item[32:232])]
    two = item[:20] + [f"y{i}" for i in range(15)] + item[35:47]
    docs = spark.createDataFrame([(1, " ".join(item[:30] + ["a", "b"] + light)), (2, " ".join(two))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    found = D.overlaps(docs, bench).collect()
    assert any(r.doc_id == 1 and r.start == 0 and r.end >= 30 for r in found)
    spans = [(r.start, r.end) for r in found if r.doc_id == 2]
    assert any(a == 0 and b >= 20 for a, b in spans) and any(a <= 35 and b == 47 for a, b in spans)
    assert D.decontaminate(docs, bench).count() == 0


def test_substitutions_at_all_places_of_short_items(spark):
    items = {n: [f"i{n}w{i}" for i in range(n)] for n in range(1, 15)}
    texts, wanted = [], set()
    for n, item in items.items():
        for places in [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            same = [i not in places for i in range(n)]
            if brute_stretches(same, min(10, n)):
                wanted.add(len(texts))
            texts.append(" ".join(["before"] * 5 + [w if s else "changed" for w, s in zip(item, same)] + ["after"] * 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id bigint, text string")
    assert {r.doc_id for r in D.overlaps(docs, bench).select("doc_id").collect()} == wanted
