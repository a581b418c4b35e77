"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Vectors are over all terms: the document frequency of every term is counted over all
documents and stays in a table. Fitting reads at most `sample` labelled documents, the lowest
by a seeded hash. Only the examples' terms and the LISTED most frequent ones travel with the
scoring function; what the other terms of a text add to its norm is a join with the table of
frequencies. None of these is frequent, so no key of that join is large.

Examples are ordered by their most frequent words, so that like ones share blocks. Terms of
few examples are merged posting by posting; of the frequent terms each block keeps the
largest weight, and a block is read for a query only if that could lift one of its examples
to the `neighbours` nearest found so far. Those left are compared exactly: sums over the
postings are kept in double precision, and the weights of their frequent terms are added.
So the neighbours are exact. Examples with equal vectors are one neighbour with all their votes. Votes are
weighted by nearness, with the share of toxic documents as prior, and toxic ones by the
factor that judges the examples best (F1) if none has a vote on itself. A text that shares
no term with an example has no neighbours; its score is the share of toxic ones among the
examples without a term.

The examples' terms are numbered in many tasks; one task, bounded by the sample, packs the
numbers. Every whole text is scored. Null and empty texts have no terms. Labels that are null are not learned, several labels of one
document count as their maximum. Without examples every score is 0; an empty table gives an
empty result. Repeated rows get equal scores. Other columns are not read.
"""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from quiltframe.functions.cells import col
from quiltframe.llm.batches import bound_batches
from quiltframe.llm.sample import among_lowest
from quiltframe.operators.scratch import store
from quiltframe.operators.skew import join_by_key

SAMPLE = 20_000
NEIGHBOURS = 25
LISTED = 200_000      # most frequent terms that travel with the examples' ones
BLOCK = 128           # examples
DENSE = 0.1           # terms of more than this share of the examples have blocks, the others plain postings
FIRST_BLOCKS = 16     # blocks that are read before the others are judged again
GROUP = 64            # examples whose largest cosine stands for them when the k-th largest is bounded
QUERIES = 128         # queries answered together
MOST_KNOWN = 2_000    # texts a task remembers between batches
PART = 1 << 18        # terms of examples that are weighed together
MOST_TERMS = 200_000  # terms a task counts before it passes them on
DIGITS = 10 ** 12     # cosines are compared with 12 decimals
PRIOR_WEIGHT = 0.5
SHOWN = 5             # terms given as evidence
WORD = re.compile(r"[^\W\d_]+")
MARKS = ".,;:!?'\"()-&%*$|#"  # often beside words, and never in one

Vector = tuple[np.ndarray, np.ndarray]  # numbers of terms, weights


def term_counts(text: str | None) -> Counter:
    text = (text or "").lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    counts = Counter(text.split())
    for token in [t for t in counts if not t.isalpha()]:  # a token of letters only is one term
        n = counts.pop(token)
        for term in WORD.findall(token):
            counts[term] += n
    return counts


def _packed(state: tuple) -> bytes:
    return zlib.compress(pickle.dumps(state, protocol=5), 1)


class Vocabulary:
    """Listed terms with their inverse document frequency; pickled without a dictionary."""

    def __init__(self, names: bytes, idf: np.ndarray):
        self.state = (names, idf)
        self.idf = idf
        self.names = zlib.decompress(names).decode().split("\n") if len(idf) else []
        self.numbers = {t: i for i, t in enumerate(self.names)}

    def __reduce__(self):
        return (Vocabulary, self.state)

    def vector(self, counts: dict[str, int]) -> tuple[Vector, float, list[tuple[str, float]]]:
        """The unit vector over listed terms, its norm before, and the other terms with 1 + log of their counts."""
        get = self.numbers.get
        term = np.fromiter((get(t, -1) for t in counts), dtype=np.int64, count=len(counts))
        weight = 1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))
        other = term < 0
        rest = [(t, w) for t, w, o in zip(counts, weight.tolist(), other.tolist()) if o] if other.any() else []
        term = term[~other]
        weight = weight[~other] * self.idf[term]
        norm = float(np.sqrt(weight @ weight))
        return (term, weight / norm if norm else weight), norm, rest


class BlockMaxIndex:
    """Unit vectors: postings of rare terms, and blocks of vectors with the largest weight of each frequent term."""

    def __init__(self, vectors: Iterable[dict[str, float]], block: int = BLOCK):
        vectors = list(vectors)
        self.numbers: dict[str, int] = {}
        term = [self.numbers.setdefault(t, len(self.numbers)) for v in vectors for t in v]
        levels, level = np.unique(np.array([w for v in vectors for w in v.values()], dtype=float), return_inverse=True)
        self._build(np.array(term, dtype=np.int32), level, levels, np.array([len(v) for v in vectors], dtype=np.int64),
                    np.ones(len(self.numbers)), block)

    @classmethod
    def of_packed(cls, packed: bytes, idf: np.ndarray) -> "BlockMaxIndex":
        """The index of the unit vectors of counted terms."""
        index = cls.__new__(cls)
        index._build(*pickle.loads(zlib.decompress(packed)), idf, BLOCK)
        return index

    def _build(self, term, level, levels, lengths, idf, block: int) -> None:
        """A vector's weights are `levels` of its terms times their `idf`, divided by its norm."""
        self.size, terms = len(lengths), len(idf)
        self.ends = np.cumsum(lengths)
        self.terms, self.level, self.levels, self.idf = term, level, levels, idf
        self.norms = np.zeros(self.size)
        self.found = np.zeros(terms)
        counts = np.zeros(terms, dtype=np.int64)
        parts, at = [], 0
        while at < self.size:  # whole vectors, about PART terms
            after = max(at + 1, int(np.searchsorted(self.ends, self._span(at).start + PART, side="right")))
            parts.append((at, after, slice(self._span(at).start, int(self.ends[after - 1]))))
            at = after
        for at, after, mine in parts:
            weight = levels[level[mine]] * idf[term[mine]]
            own = np.repeat(np.arange(after - at), lengths[at:after])
            self.norms[at:after] = np.sqrt(np.bincount(own, weight * weight, minlength=after - at))
            counts += np.bincount(term[mine], minlength=terms)
        dense = np.flatnonzero(counts > DENSE * self.size)
        self.column = np.full(terms, -1, dtype=np.int32)
        self.column[dense] = np.arange(len(dense))
        counts[dense] = 0
        self.starts = np.r_[0, np.cumsum(counts)]
        self.matrix = np.zeros((len(dense), self.size), dtype=np.float32)
        self.vectors = np.zeros(self.starts[-1], dtype=np.min_scalar_type(self.size))
        self.values = np.zeros(self.starts[-1])
        free = self.starts[:-1].copy()
        dense_columns, dense_weights = [np.zeros(0, dtype=np.int32)], [np.zeros(0)]
        dense_sizes = np.zeros(self.size, dtype=np.int64)
        for at, after, mine in parts:
            t, own = term[mine], np.repeat(np.arange(at, after), lengths[at:after])
            weight = levels[level[mine]] * idf[t] / self.norms[own]
            column = self.column[t]
            listed = column >= 0
            self.matrix[column[listed], own[listed]] = weight[listed]
            dense_columns.append(column[listed])
            dense_weights.append(weight[listed])
            dense_sizes += np.bincount(own[listed], minlength=self.size)
            rare = np.flatnonzero(column < 0)
            if len(rare):
                rare = rare[np.argsort(t[rare], kind="stable")]
                names, first, sizes = np.unique(t[rare], return_index=True, return_counts=True)
                place = np.repeat(free[names] - first, sizes) + np.arange(len(rare))
                self.vectors[place], self.values[place] = own[rare], weight[rare]
                free[names] += sizes
        # The frequent terms of each vector.
        self.dense_columns, self.dense_weights = np.concatenate(dense_columns), np.concatenate(dense_weights)
        self.dense_ends = np.cumsum(dense_sizes)
        self.firsts = np.arange(0, self.size, block)
        self.groups = np.arange(0, self.size, GROUP)
        self.largest = np.maximum.reduceat(self.matrix, self.firsts, axis=1) if self.size else self.matrix
        # Sums of products in single precision differ from the exact ones by less than this.
        self.slack = (len(dense) + 4) * 2.0 ** -22

    def nearest(self, query: dict[str, float], k: int) -> list[tuple[float, int]]:
        known = [(self.numbers[t], w) for t, w in query.items() if t in self.numbers]
        return self.nearest_all([(np.array([t for t, _ in known], dtype=np.int64), np.array([w for _, w in known]))], k)[0]

    def nearest_all(self, queries: list[Vector], k: int) -> list[list[tuple[float, int]]]:
        """For each query the k largest positive cosines with their vectors, the lowest numbers on ties."""
        if not self.size or not queries:
            return [[] for _ in queries]
        frequent = np.zeros((len(queries), len(self.matrix)))
        rare = np.zeros((len(queries), self.size))
        for row, sums, (term, weight) in zip(frequent, rare, queries):
            column = self.column[term]
            row[column[column >= 0]] = weight[column >= 0]
            term, weight = term[column < 0], weight[column < 0]
            starts, sizes = self.starts[term], self.starts[term + 1] - self.starts[term]
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1]:
                place = np.repeat(starts - ends + sizes, sizes)
                place += np.arange(ends[-1])
                values = self.values.take(place)
                values *= np.repeat(weight, sizes)
                sums[:] = np.bincount(self.vectors.take(place), values, minlength=self.size)
        exact, frequent, sums = frequent, frequent.astype(np.float32), rare.astype(np.float32)
        bound = np.maximum.reduceat(sums, self.firsts, axis=1) + frequent @ self.largest
        early = np.zeros(bound.shape, dtype=bool)
        early[:, np.argsort(-bound.sum(axis=0), kind="stable")[:FIRST_BLOCKS]] = True
        for now in (early, ~early):
            least = self._least(sums, k)
            now = now & (bound > 0) & (bound >= least[:, None] - 2 * self.slack)
            for b in np.flatnonzero(now.any(axis=0)).tolist():
                mine = slice(b * self.block_size, (b + 1) * self.block_size)
                rows = np.flatnonzero(now[:, b])
                if 4 * len(rows) < len(queries):
                    sums[rows, mine] += frequent[rows] @ self.matrix[:, mine]
                else:
                    part = frequent @ self.matrix[:, mine]
                    part[~now[:, b]] = 0
                    sums[:, mine] += part
        found = []
        for own, added, row, low in zip(exact, rare, sums, self._least(sums, k)):
            near = np.flatnonzero((row > 0) & (row >= low - 2 * self.slack))
            if len(near) > k:
                least = np.partition(row[near], -k)[-k]
                near = near[row[near] >= least - 2 * self.slack]
            found.append(self._exact(own, added, near, k))
        return found

    @property
    def block_size(self) -> int:
        return int(self.firsts[1]) if len(self.firsts) > 1 else self.size

    def _least(self, sums: np.ndarray, k: int) -> np.ndarray:
        """At most the k-th largest number of each row, and close to it; of fewer numbers 0."""
        if len(self.groups) > k:  # k groups hold a number of at least the k-th largest of their maxima
            sums = np.maximum.reduceat(sums, self.groups, axis=1)
        return np.partition(sums, -k, axis=1)[:, -k] if sums.shape[1] > k else np.zeros(len(sums))

    def _span(self, number: int) -> slice:
        return slice(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))

    def _exact(self, frequent: np.ndarray, rare: np.ndarray, near: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best of these vectors by cosines in double precision: of rare terms, and by a query's weights of frequent ones."""
        if not len(near):
            return []
        ends = self.dense_ends[near]
        sizes = ends - np.where(near > 0, self.dense_ends[near - 1], 0)
        cosine = rare[near]
        some = np.flatnonzero(sizes)
        if len(some):
            spans = list(map(slice, (ends - sizes)[some].tolist(), ends[some].tolist()))
            products = frequent[np.concatenate([self.dense_columns[x] for x in spans])]
            products *= np.concatenate([self.dense_weights[x] for x in spans])
            cosine[some] += np.add.reduceat(products, np.cumsum(sizes[some]) - sizes[some])
        cosine = np.rint(cosine * DIGITS)
        order = np.lexsort((near, -cosine))[:k]
        return list(zip((cosine[order] / DIGITS).tolist(), near[order].tolist()))

    def vector(self, number: int) -> Vector:
        mine = self._span(number)
        term = self.terms[mine].astype(np.int64)
        return term, self.levels[self.level[mine]] * self.idf[term] / self.norms[number]

    def shared(self, query: Vector, number: int, most: int) -> np.ndarray:
        """The terms that add most to the cosine of a query and a vector."""
        term, weight = self.vector(number)
        self.found[query[0]] = query[1]
        both = self.found[term] * weight
        self.found[query[0]] = 0
        order = np.lexsort((term, -both))[:most]
        return term[order][both[order] > 0]


def unit_vector(counts: dict[str, int], idf: dict[str, float], unlisted: float = 0.0) -> dict[str, float]:
    weights = {t: (1 + math.log(n)) * idf.get(t, unlisted) for t, n in sorted(counts.items())}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items() if w} if norm else {}


def held_out(id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % parts == part


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the number of rows with each term; of all rows under the null term."""
    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch["text"]:
                seen.update(term_counts(x).keys())
                seen[None] += 1  # one null term per row
                if len(seen) > MOST_TERMS:
                    yield pd.DataFrame({"term": pd.Series(list(seen), dtype=object), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"term": pd.Series(list(seen), dtype=object), "n": list(seen.values())})

    return docs.select(col(text).alias("text")).mapInPandas(terms, "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE, seed: int = 3,
          neighbours: int = NEIGHBOURS) -> dict:
    """{"frequencies", "total", "vocabulary", "packed", "examples", "factor", "empty_score", "prior"}; the held-out
    documents' labels are not read. "examples" are (number, id, examples, toxic ones) per vector of the index."""
    bound_batches(docs.sparkSession)
    marks = labels.select(col(id).cast("string").alias("label_id"), col(label).cast("int").alias("y"))
    marks = store(marks.where(~held_out(F.col("label_id")) & F.col("y").isNotNull()).groupBy("label_id").agg(
        F.max("y").alias("y")))
    marks = marks.withColumn("draw", F.xxhash64(F.lit(seed), "label_id"))
    marks = marks.where(among_lowest(F.col("draw"), sample, marks.count())).orderBy("draw").limit(
        sample)  # bounds the broadcast
    rows = docs.select(col(id).cast("string").alias("id"), col(text).alias("text")).join(
        F.broadcast(marks), F.col("id") == F.col("label_id"))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, int(y), " ".join(f"{t}:{c}" for t, c in sorted(term_counts(x).items())))
                                for i, x, y in zip(batch["id"], batch["text"], batch["y"])],
                               columns=["id", "y", "terms"])

    examples = store(rows.select("id", "text", "y").mapInPandas(reduced, "id string, y int, terms string"), "examples")
    sizes = examples.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"),
                         F.count(F.when(F.col("terms") == "", 1)).alias("empty"),
                         F.sum(F.when(F.col("terms") == "", F.col("y"))).alias("empty_y")).first()
    if not sizes.n:
        return {"examples": [], "factor": 1.0, "empty_score": 0.0, "prior": 0.0}
    prior = sizes.y / sizes.n
    seen = store(frequencies(docs, text), "frequencies")
    total = seen.where("term IS NULL").first().n
    known = seen.where("term IS NOT NULL")
    theirs = examples.where("terms <> ''").select(
        F.explode(F.transform(F.split("terms", " "), lambda x: F.substring_index(x, ":", 1))).alias("term")).distinct()
    # Bounded by the sample and LISTED.
    listed = known.join(theirs, "term", "left_semi").union(
        known.orderBy(F.desc("n"), "term").limit(LISTED)).distinct().toArrow().sort_by(
        [("n", "descending"), ("term", "ascending")])  # what is often read lies together
    names = zlib.compress("\n".join(listed["term"].to_pylist()).encode("utf-8", "surrogatepass"), 1)
    vocabulary = (names, np.log(1 + total / listed["n"].to_numpy()))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _words(*shared.value).numbers
        for batch in batches:
            yield _numbered(batch, numbers)

    # One task for at most `sample` rows.
    packed = examples.where("terms <> ''").mapInPandas(
        numbered, "one int, id string, y int, like string, terms binary, counts binary").groupBy("one").applyInPandas(
        _pack, "entries binary, vectors binary").first()
    model = {"frequencies": seen, "total": total, "vocabulary": vocabulary, "prior": prior,
             "empty_score": ((sizes.empty_y or 0) + prior) / (sizes.empty + 1), "factor": 1.0,
             "packed": bytes(packed.vectors) if packed else None,
             "examples": pickle.loads(bytes(packed.entries)) if packed else []}
    if packed:
        model["factor"] = toxic_factor(spark, model, neighbours)
    return model


def _numbered(batch: pd.DataFrame, numbers: dict[str, int]) -> pd.DataFrame:
    """Examples with numbers in place of terms, and the most frequent words: where these agree, they are likely alike."""
    out = []
    for i, y, terms in zip(batch["id"], batch["y"].tolist(), batch["terms"]):
        pairs = [x.rsplit(":", 1) for x in terms.split(" ")]
        counts = np.array([int(n) for _, n in pairs], dtype=np.int32)
        like = " ".join(pairs[j][0] for j in np.argsort(-counts, kind="stable")[:3])
        out.append((0, i, y, like, np.array([numbers[t] for t, _ in pairs], dtype=np.int32).tobytes(), counts.tobytes()))
    return pd.DataFrame(out, columns=["one", "id", "y", "like", "terms", "counts"])


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """The entries (number, first id, examples, toxic ones) and vectors of examples; equal ones are one entry."""
    held: list[list] = []
    terms, counts, last = [], [], None
    for like, t, c, i, y in sorted(zip(group["like"], group["terms"], group["counts"], group["id"], group["y"].tolist())):
        if (t, c) != last:
            held.append([len(held), i, 0, 0])
            terms.append(t)
            counts.append(c)
            last = t, c
        held[-1][2] += 1
        held[-1][3] += y
    lengths = np.array([len(t) // 4 for t in terms], dtype=np.int64)
    term, count = (np.frombuffer(b"".join(x), dtype=np.int32) for x in (terms, counts))
    known = np.unique(count)
    level = np.searchsorted(known, count).astype(np.min_scalar_type(len(known)))
    return pd.DataFrame({"entries": [pickle.dumps([tuple(x) for x in held])],
                         "vectors": [_packed((term, level, 1 + np.log(known), lengths))]})


def votes(found: list[tuple[float, int, int]], prior: float) -> tuple[float, float]:
    """Toxic and other votes of neighbours: cosine, examples, toxic ones."""
    total = sum(n / (1.05 - s) for s, n, _ in found)
    share = PRIOR_WEIGHT * total / sum(n for _, n, _ in found)
    toxic = sum(k / (1.05 - s) for s, _, k in found) + share * prior
    return toxic, total + share - toxic


_HELD: dict = {}


def _kept(kind: str, mark: bytes, make):
    """One object of a kind, kept by the worker for its later tasks."""
    if _HELD.get(kind, (None,))[0] != mark:
        _HELD.pop(kind, None)
        _HELD[kind] = mark, make()
    return _HELD[kind][1]


def _words(names: bytes, idf: np.ndarray) -> Vocabulary:
    mark = hashlib.blake2b(names + idf.tobytes(), digest_size=16).digest()
    return _kept("vocabulary", mark, lambda: Vocabulary(names, idf))


def _index(packed: bytes | None, idf: np.ndarray) -> BlockMaxIndex:
    mark = hashlib.blake2b((packed or b"") + idf.tobytes(), digest_size=16).digest()
    return _kept("index", mark, lambda: BlockMaxIndex.of_packed(packed, idf) if packed else BlockMaxIndex([]))


def toxic_factor(spark: SparkSession, model: dict, neighbours: int) -> float:
    """The weight of toxic votes with the best F1 on the examples, each judged by the others."""
    held, prior = [(n, k) for _, _, n, k in model["examples"]], model["prior"]
    shared = spark.sparkContext.broadcast((held, model["packed"], model["vocabulary"][1]))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, packed, idf = shared.value
        index = _index(packed, idf)
        for batch in batches:
            out, mine = [], batch["id"].tolist()
            for i, near in zip(mine, index.nearest_all([index.vector(i) for i in mine], neighbours + 1)):
                n, k = held[i]
                for y, copies in ((1, k), (0, n - k)):
                    rest = [(s, *((n - 1, k - y) if j == i else held[j])) for s, j in near]
                    rest = [x for x in rest if x[1]][:neighbours]
                    if copies and rest:
                        toxic, other = votes(rest, prior)
                        out.append((other / toxic if toxic else None, y, copies))
            yield pd.DataFrame(out, columns=["factor", "y", "copies"])

    tasks = -(-len(held) // QUERIES)
    found = spark.range(0, len(held), 1, tasks).mapInPandas(judged, "factor double, y int, copies bigint").groupBy(
        "factor").agg(F.sum(F.col("y") * F.col("copies")).alias("toxic"), F.sum("copies").alias("n")).collect()
    every, hits, taken, best, factor = sum(r.toxic for r in found), 0, 0, 0.0, 1.0
    steps = sorted((r.factor, r.toxic, r.n) for r in found if r.factor is not None)
    for (at, toxic, n), after in zip(steps, [*steps[1:], None]):
        hits, taken = hits + toxic, taken + n
        f1 = 2 * hits / (taken + every) if every else 0.0
        if f1 > best:
            best, factor = f1, (at + after[0]) / 2 if after else at
    return factor


NEAR = pa.list_(pa.struct([("s", pa.float64()), ("n", pa.int32()), ("k", pa.int32())]))
REST = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
FOUND = {"digest": pa.binary(), "listed": pa.float64(), "near": NEAR, "words": pa.string(),
         "shown": pa.list_(pa.string()), "rest": REST}


def _found(docs: DataFrame, model: dict, id: str, text: str, neighbours: int) -> DataFrame:
    """Per row its id and, by terms that are listed, the neighbours with their cosines; `rest` once per text and part."""
    entries = [entry for _, *entry in model["examples"]]
    shared = docs.sparkSession.sparkContext.broadcast((entries, model["packed"], model["vocabulary"]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, packed, listed = shared.value
        vocabulary, index = _words(*listed), _index(packed, listed[1])
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                texts = part.column("text").to_pylist()
                keys = [hashlib.blake2b((x or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
                if len(known) > MOST_KNOWN:
                    known.clear()
                fresh = {k: x for k, x in zip(keys, texts) if k not in known}
                made = [vocabulary.vector(term_counts(x)) for x in fresh.values()]
                rests = {}
                for k, (vector, norm, rest), near in zip(
                        fresh, made, index.nearest_all([v for v, _, _ in made], neighbours)):
                    shown = index.shared(vector, near[0][1], SHOWN).tolist() if near else []
                    known[k] = (norm, [(s, *entries[i][1:]) for s, i in near], " ".join(vocabulary.names[t] for t in shown),
                                [f"{entries[i][0]}={entries[i][2]}/{entries[i][1]} at " for _, i in near[:3]])
                    if rest and near:
                        rests[k] = rest
                columns = zip(*((k, *known[k], rests.pop(k, None)) for k in keys))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(x, kind) for x, kind in zip(columns, FOUND.values()))],
                    names=["id", *FOUND])

    rows = docs.select(col(id).alias("id"), col(text).alias("text"))
    schema = StructType([rows.schema["id"], *from_arrow_schema(pa.schema(FOUND))])
    return store(rows.mapInArrow(found, schema), "neighbours")


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text",
          neighbours: int = NEIGHBOURS, threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, evidence) for every row. Evidence are the terms shared most with the nearest
    example, and the nearest three with toxic ones, examples and cosine."""
    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score",
                           (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

    if not model["examples"]:
        return shaped(docs.select(col(id).alias("id"), F.lit(float(model["empty_score"])).alias("score"),
                                  F.lit("").alias("evidence")))
    bound_batches(docs.sparkSession)
    rows = _found(docs, model, id, text, neighbours)
    # Terms that are not listed: their weights need the table of frequencies.
    rest = rows.where("rest IS NOT NULL").select("digest", F.explode("rest").alias("r")).select("digest", "r.*")
    rest = rest.repartition("term").groupBy("term", "digest").agg(F.max("w").alias("w"))
    # Scored texts may hold terms that the counted ones lack; these count as in one document.
    squares = rest.join(model["frequencies"], "term", "left").groupBy("digest").agg(F.sum(F.pow(
        F.col("w") * F.log(1 + F.lit(model["total"]) / F.coalesce("n", F.lit(1))), F.lit(2))).alias("rest2"))
    texts = store(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(squares, "digest", "left").select(
        "digest", "copies", F.coalesce("rest2", F.lit(0.0)).alias("rest2")))
    joined = join_by_key(rows.drop("rest"), texts, ["digest"], "copies")
    share = F.col("listed") / F.nullif(F.sqrt(F.col("listed") * F.col("listed") + F.col("rest2")), F.lit(0.0))
    joined = joined.withColumn("near", F.transform("near", lambda x: F.struct(
        F.round(x["s"] * share, 12).alias("s"), x["n"].alias("n"), x["k"].alias("k"))))

    def summed(value) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda total, x: total + value(x))

    joined = joined.withColumns({
        "_all": summed(lambda x: x["n"] / (1.05 - x["s"])), "_toxic": summed(lambda x: x["k"] / (1.05 - x["s"])),
        "_share": PRIOR_WEIGHT * summed(lambda x: x["n"] / (1.05 - x["s"])) / F.nullif(
            summed(lambda x: x["n"].cast("double")), F.lit(0.0))})
    joined = joined.withColumn("_toxic", F.col("_toxic") + F.col("_share") * model["prior"])
    other, toxic = F.col("_all") + F.col("_share") - F.col("_toxic"), F.col("_toxic") * model["factor"]
    some = F.size("near") > 0
    shown = F.transform(F.col("shown"), lambda x, i: F.concat(x, F.format_string("%.3f", F.get(F.col("near"), i)["s"])))
    return shaped(joined.select(
        "id", F.when(some, toxic / (toxic + other)).otherwise(F.lit(float(model["empty_score"]))).alias("score"),
        F.when(some, F.concat(F.col("words"), F.lit("; "), F.array_join(shown, ", "))).otherwise("").alias("evidence")))
