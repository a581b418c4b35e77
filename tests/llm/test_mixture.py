import itertools
import random

import pytest
from pyspark.sql import functions as F

from quiltframe.llm import mixture as M


def best_below(sizes, counts, budget):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + k * s for x in sums for k in range(c + 1)}
    return max(x for x in sums if x <= budget)


def test_fit_is_a_best_subset_sum():
    rng = random.Random(1)
    for _ in range(300):
        sizes = rng.sample(range(0, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts)) + 5)
        taken = M.fit_counts(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(s * t for s, t in zip(sizes, taken)) <= budget
        # The same share of every size goes first; what remains is fitted as well as it can be.
        first = [c * min(budget, sum(s * c for s, c in zip(sizes, counts))) // max(1, sum(
            s * c for s, c in zip(sizes, counts))) if s else 0 for s, c in zip(sizes, counts)]
        left = min(budget, sum(s * c for s, c in zip(sizes, counts))) - sum(s * f for s, f in zip(sizes, first))
        rest = best_below(sizes, [c - f for c, f in zip(counts, first)], left)
        assert sum(s * (t - f) for s, t, f in zip(sizes, taken, first)) == rest


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, itertools.cycle(weights)))
    target, left, free = {n: 0.0 for n in names}, share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        each = left / sum(weight[n] for n in free)
        left = 0.0
        for n in list(free):
            target[n] += each * weight[n]
            if target[n] >= most * sizes[n]:
                left += target[n] - most * sizes[n]
                target[n] = most * sizes[n]
                free.remove(n)
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 3, 3, 3, 7, 50, rng.randint(1, 400)]), rng.choice(["a", "a", "a", "B", "é", "c", None]))
            for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", None), (2002, "\t \n", "zero"), (None, "null id", "c"), rows[7], (2003, "x " * 200000, "B")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))


def test_targets_and_budgets(docs):
    rows = M.mix(docs.repartition(5), keep=("source",)).collect()
    assert len(rows) == 1506
    sizes = {}
    for r in rows:
        sizes[r.kept.source] = sizes.get(r.kept.source, 0) + r["size"]
    want = brute_targets(sizes)
    for name, words in sizes.items():
        mine = [r for r in rows if r.kept.source == name]
        assert {r.source_size for r in mine} == {words}
        assert all(abs(r.target - want[name]) < 1e-6 for r in mine)
        taken = sum(r.taken for r in mine)
        if name == "B":  # its long document fits once; all others are taken twice
            assert taken == 2 * words - 200000
        else:
            assert abs(taken - want[name]) <= 8
    assert all(r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in rows)
    again = M.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in rows)


def test_shuffled_plans(docs, monkeypatch):
    one = sorted((r.doc_id or -1, r.taken) for r in M.mix(docs).collect())
    monkeypatch.setattr(M, "BROADCAST_PLANS", 0)
    assert sorted((r.doc_id or -1, r.taken) for r in M.mix(docs).collect()) == one


def test_empty(docs):
    assert M.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in M.mix(docs.where("source = 'zero'")).collect()] == [0]


def test_nearest_from_either_side():
    assert M.fit_nearest([1000, 20000], [3, 1], 18400) == [0, 1]
    assert M.fit_nearest([5000], [1], 4900) == [1] and M.fit_nearest([5000], [1], 2400) == [0]
    assert M.fit_nearest([10 ** 6, 10 ** 9], [1000, 1], 9 * 10 ** 8 + 5) == [900, 0]
    assert M.fit_nearest([3, 10 ** 9], [10, 1], 9 * 10 ** 8) == [0, 1]
    rng = random.Random(2)
    for _ in range(300):
        sizes = rng.sample(range(0, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = rng.randint(0, total + 5)
        taken = M.fit_nearest(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        # At least as near as the best sum on what the fixed share leaves.
        first = [c * min(budget, total) // max(1, total) if s else 0 for s, c in zip(sizes, counts)]
        sums = {sum(s * f for s, f in zip(sizes, first))}
        for s, c, f in zip(sizes, counts, first):
            sums = {x + k * s for x in sums for k in range(c - f + 1)}
        error = abs(budget - sum(s * t for s, t in zip(sizes, taken)))
        assert error <= min(abs(budget - x) for x in sums)


def test_a_long_document_just_over_its_target_is_taken(spark):
    rows = [(1, "w " * 1000, "a"), (2, "w " * 1000, "a"), (3, "w " * 1000, "a"), (4, "w " * 20000, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = M.mix(docs, share=1.8).collect()
    assert sum(r.taken for r in found) == 43000 and {round(r.target) for r in found} == {41400}
