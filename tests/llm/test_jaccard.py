import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiltframe.llm import graph, jaccard_join as J
from quiltframe.llm.hashing import shingles


def words_of(text):
    out, word = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}):
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def brute_set(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 90, 200]))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[:rng.randint(len(copy) * 3 // 4, len(copy))]
            if rng.random() < 0.3:
                copy = line + copy
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "one", "One", "one two three four", "ONE two three four", "ÉA b c d e", "éa b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small):
    if small:  # many blocks, long lists, shuffled ids
        for name, value in (("INDEX_BLOCK", 7), ("QUERY_BLOCK", 5), ("LONG_LIST", 9), ("COMPARED", 30), ("BROADCAST_IDS", 0)):
            monkeypatch.setattr(J, name, value)
    rows = made(seed)
    docs = spark.createDataFrame(rows + [rows[3], rows[3]], "doc_id bigint, text string").withColumn("id", F.lit("x"))
    got = J.grouped(docs.repartition(4)).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = J.one_of_each(docs.repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    one, two = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, one, "s"), (1, two, "s"), (1, two, "t"), (5, one, "s"), (5, "x y z u v w", "s"), (None, one, "s"),
            (7, None, "s"), (7, None, "t"), (7, None, "t"), (8, two, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("id", F.lit("clash"))
    left = [[tuple(r)[:3] for r in J.one_of_each(docs.repartition(n)).collect()] for n in (1, 5)]
    left = [sorted(rows, key=str) for rows in left]
    assert left[0] == left[1] and {(i, t) for i, t, _ in left[0]} == {
        (1, one), (1, two), (5, "x y z u v w"), (None, one), (7, None)}
    assert sum(i == 7 for i, *_ in left[0]) == 2 and len(left[0]) == 6


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.grouped(docs).collect()}
    assert got == {(None, 2, None), (1, 2, 1), (2, 0, 2)}
    assert J.grouped(docs.limit(0)).count() == 0


def test_divide_skip_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    lists = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            lists.setdefault(x, []).append(i)
    for query in sets[:30]:
        for least in (1, 3, 8, 15):
            want = {i: len(np.intersect1d(query, s)) for i, s in enumerate(sets)}
            assert dict(J.divide_skip(query, lists, least)) == {i: n for i, n in want.items() if n >= least}


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 95: 90, 100: 90}


def test_shingles_of_short_texts():
    assert len(shingles("a b c d e", 5)) == 1 and len(shingles("a b", 5)) == 1 and len(shingles(" ", 5)) == 0
    assert shingles("A b", 5)[0] == shingles("a  b", 5)[0] != shingles("ab", 5)[0]


def test_signs_allow_every_link():
    rng = np.random.default_rng(8)
    every = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    refused = 0
    for _ in range(400):
        n1, n2 = rng.integers(1, 900, 2).tolist()
        shared = int(rng.integers(0, min(n1, n2) + 1))
        x, y = np.sort(every[:n1]), np.sort(every[n1 - shared:n1 - shared + n2])
        allowed = J.signs_allow(n1, J.sign(x), n2, J.sign(y), 75)
        assert allowed or not J._links(n1, n2, shared, 75)
        refused += not allowed
    assert refused > 200
    assert J.signs_allow(1, J.sign(every[:1]), 1, J.sign(every[:1]), 100)


def test_unlike_sets_are_not_read_again(spark, monkeypatch):
    """Documents that share half their shingles with two others each, and a few near copies."""
    rng = random.Random(9)
    blocks = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(40)) for _ in range(300)]
    texts = [f"{blocks[i]} {blocks[i - 1]}" for i in range(300)]
    near = [f"{texts[i]} another end" for i in (5, 50, 200)]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id bigint, text string")
    read, sets = [], J._sets
    monkeypatch.setattr(J, "_sets", lambda d, ids, *rest: read.append(ids.distinct().count()) or sets(d, ids, *rest))
    found = {r.doc_id: r.component_id for r in J.grouped(docs).collect()}
    assert found == {i: i for i in range(300)} | {300: 5, 301: 50, 302: 200}
    assert sum(read) <= 20


def test_long_and_short_lists_give_the_same(spark, monkeypatch):
    """Groups of near copies whose lists are named pair by pair, by labels, and by cells."""
    rng = random.Random(10)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(60)]
        for _ in range(25):
            new = list(words)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(60)] = f"x{rng.randint(0, 10**9)}"
            texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = [set(shingles(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(own):
        for j in range(i):
            if 100 * len(x & own[j]) >= 75 * len(x | own[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    for short, named in ((32, 16), (2, 16), (2, 0)):
        monkeypatch.setattr(J, "SHORT_LIST", short)
        monkeypatch.setattr(J, "NAMED", named)
        assert [r.component_id for r in J.grouped(docs).orderBy("doc_id").collect()] == label


def test_a_batch_is_scanned_in_slices():
    """The sets of a batch are never held together."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[i:] + words[:i]) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": texts})
    tracemalloc.start()
    n = sum(x.num_rows for x in J._scan(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 + J.COUNTER_PARTS
    assert peak < 2000 * 3000 * 8 * 1.5  # one copy of all sets and half another
