"""Language, quality and toxicity: held-out accuracy, edge cases, exactness of the index."""

import math
import pickle
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiltframe.llm import grams, language, quality_model, toxicity

FOLDER = "/root/testdata/sf0.01"
ODD = [(100001, None, None, "x"), (100002, "", "en", "x"), (100003, "12 34 !!", "de", "x"),
       (100004, "the " * 30000, None, "y"), (None, "and the of to", "en", None), (None, "and the of to", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    real = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("n_chars")
    return real.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))


def test_language_held_out(docs):
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs, learn=~out)
    found = language.identify(docs, model, keep=("lang",)).withColumn("out", language.held_out(F.col("id"))).collect()
    assert len(found) == 1000 + len(ODD)
    real = [r for r in found if r.id is not None and r.id < 100000 and r.out]
    assert np.mean([r.lang_pred == r.kept.lang for r in real]) > 0.97
    odd = {r.id: r for r in found if r.id is not None and r.id > 100000}
    assert [odd[100000 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[100004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found)


def test_language_without_rows(docs):
    model = language.train(docs.limit(0))
    assert language.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs.limit(20), model).collect()} == {"und"}


def test_language_one_language(spark):
    one = spark.createDataFrame([(1, "abc def", "xx"), (2, "ghi", "xx")], "doc_id int, text string, lang string")
    assert {r.lang_pred for r in language.identify(one, language.train(one)).collect()} == {"xx"}


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    side = x @ np.array([1, -2, 0, 0, 1.0]) > 0.3
    w = grams.train_svm(x, side, cost=100.0, steps=500)
    assert np.mean((x @ w[:-1] + w[-1] > 0) == side) > 0.97


def test_quality_finds_labels(docs, spark):
    model = quality_model.train(docs, sample=600)
    found = quality_model.score(docs, model)
    assert found.count() == 1000 + len(ODD)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").collect()
    assert np.mean([(r.weak_label > 0.5) == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert 0.7 < model["share"] < 0.95


def test_quality_scores_votes_never_seen(docs):
    model = quality_model.train(docs.where("doc_id % 7 = 0"))
    rows = quality_model.voted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    patterns = {tuple(r.votes) for r in rows}
    assert patterns - set(model["posterior"])
    found = quality_model.score(docs, model).collect()
    assert len(found) == 1000 + len(ODD) and all(0 <= r.weak_label <= 1 for r in found)
    votes = {r.doc_id: tuple(r.votes) for r in rows}
    for r in found:
        if votes[r.doc_id] in model["posterior"]:
            assert math.isclose(r.weak_label, model["posterior"][votes[r.doc_id]], abs_tol=1e-6)


def test_quality_empty(docs):
    model = quality_model.train(docs.limit(0))
    assert quality_model.score(docs.limit(0), model).count() == 0
    assert quality_model.score(docs.limit(3), model).count() == 3


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, tables, _ = quality_model.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02
    assert np.abs(tables[:, 1, 1] - right).max() < 0.03 and np.abs(tables[:, 0, 0] - right).max() < 0.05


def test_block_max_search_is_exact():
    rng = random.Random(4)
    terms = [f"t{i}" for i in range(30)]
    idf = {t: rng.uniform(0.5, 5) for t in terms}
    vectors = [toxicity.unit_vector({t: rng.randint(1, 4) for t in rng.sample(terms, rng.randint(1, 6))}, idf)
               for _ in range(500)]
    vectors += vectors[:40]
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for _ in range(60):
        query = toxicity.unit_vector({t: rng.randint(1, 3) for t in rng.sample(terms, rng.randint(1, 5))}, idf)
        cosines = [sum(w * v.get(t, 0.0) for t, w in query.items()) for v in vectors]
        want = sorted((-round(s, 12), i) for i, s in enumerate(cosines) if s > 0)[:10]
        got = index.nearest(query, 10)
        assert [i for _, i in got] == [i for _, i in want]
        assert all(math.isclose(a, -b) for (a, _), (b, _) in zip(got, want))


def test_toxicity_held_out(docs, spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").withColumn("text", F.lit("clash"))
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == 1000 + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth]) > 0.95
    same = [r for r in found if r.doc_id is None]
    assert same[0].score == same[1].score


def test_toxicity_without_labels(docs, spark):
    labels = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    rows = toxicity.score(docs.limit(5), toxicity.train(docs, labels)).collect()
    assert [r.score for r in rows] == [0.0] * 5


def test_toxicity_empty(docs, spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("listed", [200_000, 3])
def test_toxicity_neighbours_over_all_terms(spark, monkeypatch, listed):
    monkeypatch.setattr(toxicity, "LISTED", listed)  # the other terms reach the norms by a join
    rng = random.Random(6)
    texts = [" ".join(f"v{'abcdefghij'[rng.randint(0, 9)]}{'abcdefghij'[rng.randint(0, 9)]}" for _ in range(rng.randint(1, 25)))
             for _ in range(80)] + [f"lone{c}" for c in "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = [(i, i % 3 // 2 if i < 60 else None) for i in range(80)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    # The draw is as large as there are labels to learn, whatever else the table holds.
    nulls = spark.createDataFrame([(10000 + i, None) for i in range(5000)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels.union(nulls))
    out = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    learned = {int(i): k for _, i, n, k in model["examples"]}
    assert sum(n for _, _, n, _ in model["examples"]) == len([i for i, y in marks if y is not None and i not in out])
    counts = [toxicity.term_counts(t) for t in texts]
    idf = {t: math.log(1 + len(texts) / sum(t in c for c in counts)) for c in counts for t in c}

    def vector(c):
        weights = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    near = 0
    for i in sorted(out - {80, 81, 82}):
        mine = vector(counts[i])
        best = max(sum(w * vector(counts[j]).get(t, 0.0) for t, w in mine.items()) for j in learned)
        near += best > 0
        shown = found[i].evidence.rsplit("; ", 1)[-1].split(", ")[0]
        assert (f"at {best:.3f}" in shown) == (best > 0)
    assert near > 5 and found[80].evidence == "" == found[81].evidence


def test_index_is_built_in_parts(monkeypatch):
    """Weighing and sorting the examples' terms takes little beside what the index keeps, and parts change nothing."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 600, 1500)
    idf = np.sort(rng.uniform(0.1, 9, 200_000))
    term = np.concatenate([rng.choice(len(idf), n, replace=False) for n in lengths]).astype(np.int32)
    counts = rng.integers(1, 5, len(term)).astype(np.int32)
    vector = np.repeat(np.arange(len(lengths)), lengths)
    group = pd.DataFrame({"like": "", "id": [str(i) for i in range(len(lengths))], "y": 0,
                          "terms": [x.tobytes() for x in np.split(term, np.cumsum(lengths)[:-1])],
                          "counts": [x.tobytes() for x in np.split(counts, np.cumsum(lengths)[:-1])]})
    made = toxicity._pack(group)
    held = [int(i) for _, i, _, _ in pickle.loads(made["entries"][0])]
    monkeypatch.setattr(toxicity, "PART", 20_000)
    tracemalloc.start()
    index = toxicity.BlockMaxIndex.of_packed(made["vectors"][0], idf)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - now < 16 * len(term)
    weight = (1 + np.log(counts)) * idf[term]
    weight /= np.sqrt(np.bincount(vector, weight * weight))[vector]
    for i in (0, 700, 1499):
        query = np.zeros(len(idf))
        query[term[vector == i]] = weight[vector == i]
        cosine = np.bincount(vector, weight * query[term])
        want = np.argsort(-cosine, kind="stable")[:20]
        got = index.nearest_all([(term[vector == i].astype(np.int64), weight[vector == i])], 20)[0]
        assert [held[n] for _, n in got] == want.tolist()
        assert np.allclose([s for s, _ in got], cosine[want], rtol=0, atol=1e-11)


def test_search_reads_no_term_of_an_example_again():
    """Postings give the part of rare terms once; beside it only the frequent terms of the nearest examples are read."""
    rng = random.Random(8)
    often, rare = [f"o{i}" for i in range(6)], [f"r{i}" for i in range(300)]
    vectors = [toxicity.unit_vector({t: rng.randint(1, 3) for t in rng.sample(often, rng.randint(0, 4)) + rng.sample(rare, 5)},
                                    dict.fromkeys(often, 0.7) | dict.fromkeys(rare, 4.0)) for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, block=16)
    assert len(index.matrix) == len(often)
    index.terms = index.level = None
    for query in vectors[:20] + [{"o1": 0.6, "o2": 0.8}, {"r7": 1.0}, {"unknown": 1.0}]:
        cosines = [sum(w * v.get(t, 0.0) for t, w in query.items()) for v in vectors]
        want = sorted((-round(s, 12), i) for i, s in enumerate(cosines) if s > 0)[:7]
        got = index.nearest(query, 7)
        assert [i for _, i in got] == [i for _, i in want]
        assert all(math.isclose(a, -b, abs_tol=2e-12) for (a, _), (b, _) in zip(got, want))


def test_terms_are_runs_of_letters():
    rng = random.Random(9)
    signs = "abÄßσΣİıñ中かﬁ²½Ⅷ٣09_.,;:!?'\"()-&%*$|#@+~/\\\t\n\x1c\x85\xa0\u2009\u200b\u0307 "
    for text in ["", None, *("".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000))]:
        assert toxicity.term_counts(text) == Counter(toxicity.WORD.findall((text or "").lower()))
