import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quiltframe.llm import repeats as R


def brute(texts, least):
    where = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - least + 1):
            where.setdefault(b[i:i + least], []).append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i:i + least] = b"\1" * least
    out = []
    for b, g in zip(data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        runs = sum(1 for i, y in enumerate(g) if y and (i == 0 or not g[i - 1]))
        out.append((len(b), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, count=60):
    rng = random.Random(seed)

    def prose(n, letters="abcdé "):
        return "".join(rng.choice(letters) for _ in range(n))

    shared = [prose(n) for n in (30, 39, 40, 41, 60, 90, 150, 400)]
    texts = [None, "", "short", "x" * 500, "ab" * 300, "ab" * 150 + "c"]
    for _ in range(count):
        parts = [prose(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 4)
            parts += [s[a:len(s) - rng.randint(0, len(s) // 4)], prose(rng.randint(0, 30))]
        texts.append("".join(parts))
    texts += [texts[10], texts[10], texts[12] + "tail", "head" + texts[13]]
    return texts


@pytest.mark.parametrize("seed,long", [(1, 50_000), (2, 50_000), (3, 2)])
def test_equals_brute_force(spark, seed, long):
    texts = made(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string").repartition(3)
    got = R.remove_repeats(docs, least=40, gram=12, long=long).collect()
    assert len(got) == len(texts)
    want = brute(texts, 40)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_odd_rows(spark):
    text = "some passage of words that is long enough to be seen " * 2
    rows = [(None, text), (None, text), (5, text + "a"), (5, "different"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in R.remove_repeats(docs, least=40, gram=12).collect())
    assert got == sorted((n, r) for n, r, _, _ in brute([t for _, t in rows], 40))
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_intervals_of_a_tree():
    # suffixes sorted: prefixes 3, 1, 2, 2, 0
    assert list(R.intervals(R.np.array([3, 1, 2, 2, 0]), 1)) == [(3, 0, 1), (2, 2, 4), (1, 0, 4)]
    assert list(R.intervals(R.np.array([]), 1)) == []


def test_repeats_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("n", F.lit(1))
    texts = docs.orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in texts], brute([r.text for r in texts], 200)))
    for r in R.remove_repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
