"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its connected components.

A document is the set of its distinct word shingles. Two documents link if the shared
shingles are at least `percent` hundredths of their union; every link between different
sets is found, or its two ends are already connected through others.

1. Equal sets are one document from here on, known by their smallest id.
2. A fixed-size table of counters over all shingles of all documents orders shingles from
   rare to frequent. A document that overlaps another in T shingles shares one of all but
   its T - 1 most frequent. Only these short lists are built: (shingle, document). Where
   in both orders a shared shingle stands, and the two sizes, bound the overlap; most
   lists end there. How well the counters tell rare shingles apart changes the length of
   the lists, never the result.
3. Of every list, the other documents are compared with its smallest one. Documents that
   link to it take its label. This leaves a large group of near copies as one label.
   Before any set is read again, pairs must pass their signs: bit i of a document's sign is
   the parity of its shingles that fall on i. Bits in which two signs differ are no more
   than shingles that only one of the sets has, so no link is lost.
4. Possible pairs of different labels whose signs allow a link send their documents to a
   cell, and so do lists that hold too many such pairs to name them. In a cell every document that has not the cell's most common label is a query:
   its short inverted lists are merged with a heap, candidates are looked up in the long
   ones by binary search until they reach the required overlap or cannot.
   Cells are cut into blocks of INDEX_BLOCK indexed documents and QUERY_BLOCK queries.
5. Components of all links.

No list is shortened: a list too long to be compared pair by pair sends all its documents
on. Documents copied within one task build their lists once.

Null and empty texts have no shingle and link with nothing. A text of fewer words than a
shingle is one shingle. Rows with a null id have a null component and link with nothing;
rows that share an id are one node. Other columns of the input are not read.
"""

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.cells import col, flat_columns
from quiltframe.llm.graph import components
from quiltframe.llm.hashing import shingles
from quiltframe.llm.runs import by_key, groups
from quiltframe.operators.ordered import dense_position
from quiltframe.operators.scratch import store
from quiltframe.operators.skew import join_by_key

WIDTH, PERCENT = 5, 75
COUNTERS, COUNTER_PARTS = 1 << 20, 16
INDEX_BLOCK, QUERY_BLOCK = 2000, 2000
LONG_LIST, COMPARED = 200_000, 1 << 26
SHORT_LIST = 32   # documents of a list whose possible pairs are named without labels
NAMED = 16        # possible pairs a document of a longer list, above which all go to a cell
LEAST_BITS = 64
SLICE = 500       # documents of a batch whose sets a task holds at once
SCANNED = pa.schema({"id": pa.int64(), "n": pa.int64(), "mark": pa.binary(), "sign": pa.binary(), "part": pa.int32(),
                     "counters": pa.binary()})
ENTRIES = pa.schema({"key": pa.int64(), "id": pa.int64(), "n": pa.int32(), "at": pa.int32()})
BROADCAST_IDS = 1_000_000


def _ceil(a, b):
    return -(-a // b)


def sign(s: np.ndarray) -> bytes:
    """Parities of a set's shingles by their high bits: a power of two of bits, one a shingle at least."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def signs_allow(n1: int, sign1: bytes, n2: int, sign2: bytes, percent: int) -> bool:
    """Whether sets of these sizes and signs can link."""
    x, y = np.frombuffer(sign1, dtype=np.uint64), np.frombuffer(sign2, dtype=np.uint64)
    most = n1 + n2 - 2 * _ceil(percent * (n1 + n2), 100 + percent)
    while len(x) != len(y):  # the sign of half as many bits is that of neighbouring bits together
        if len(x) > len(y):
            x, y = y, x
        odd = np.unpackbits(y.view(np.uint8))
        y = np.packbits(odd[::2] ^ odd[1::2]).view(np.uint64)
    return int(np.bitwise_count(x ^ y).sum()) <= most


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts, SLICE rows at a time: a batch's sets are several times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column("id"), part.column("text").to_pylist()


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _scan(width: int):
    """Per document its size, the digest and the sign of its set; per task the counters of its shingles."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.uint32)
        for ids, texts in _slices(batches):
            sets = [shingles(t, width) for t in texts]
            every = np.concatenate(sets) % np.uint64(COUNTERS)
            counters += np.bincount(every.astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            yield _rows(SCANNED, ids, [len(s) for s in sets],
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        [sign(s) if len(s) else None for s in sets], [None] * len(sets), [None] * len(sets))
        if counters.any():
            none = [None] * COUNTER_PARTS
            yield _rows(SCANNED, none, [0] * COUNTER_PARTS, none, none, range(COUNTER_PARTS),
                        [c.tobytes() for c in np.split(counters, COUNTER_PARTS)])
    return scan


def _sum_counters(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // COUNTER_PARTS, dtype=np.uint64)
    for data in group["counters"]:
        total += np.frombuffer(data, dtype=np.uint32)
    return pd.DataFrame({"part": group["part"].iloc[:1], "counters": [total.tobytes()]})


def _lists(counters, width: int, percent: int):
    """The short lists' entries: shingle, document, size of its set, place in its order."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for every, texts in _slices(batches):
            keys, ids, sizes, places = [], [], [], []
            for id, text in zip(every.to_pylist(), texts):
                s = shingles(text, width)
                mark = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if not len(s) or mark in seen:
                    continue
                seen.add(mark)
                short = len(s) - _ceil(percent * len(s), 100) + 1
                often = counters.value[(s % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((s, often))[:short]
                keys.append(s[first].view(np.int64))
                ids.append(np.full(short, id, dtype=np.int64))
                sizes.append(np.full(short, len(s), dtype=np.int32))
                places.append(np.arange(short, dtype=np.int32))
            if keys:
                yield _rows(ENTRIES, *(np.concatenate(x) for x in (keys, ids, sizes, places)))
    return build


def _possible(n1, at1, n2, at2, percent: int):
    """Whether sets of these sizes that share a shingle at these places can link."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    # Required overlap: inter >= p (n1 + n2 - inter).
    need = _ceil(percent * (n1.astype(np.int64) + n2), 100 + percent)
    return (100 * low >= percent * high) & (
        np.minimum(at1, at2) + 1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1) >= need)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of lists with several documents."""
    for rows, part in by_key(batches, 1 << 20):
        starts, sizes = groups(rows["key"].to_numpy())
        yield rows if part else rows[np.repeat(sizes > 1, sizes)]


def _pairs(percent: int):
    """Possible pairs: `named` 0 with the list's smallest document, 1 others of short lists; 2: entries of other lists."""
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, centre = None, None
        for rows, part in by_key(batches, 1 << 20):
            keys, ids = rows["key"].to_numpy(), rows["id"].to_numpy()
            n, at = rows["n"].to_numpy(), rows["at"].to_numpy()
            starts, sizes = groups(keys)
            # Rows of a key come by id; the parts of a long key share the first part's centre.
            first = np.stack([ids[starts], n[starts], at[starts]])
            if key is not None and keys[0] == key:
                first[:, 0] = centre
            key, centre = keys[-1], first[:, -1].copy()
            c, cn, cat = np.repeat(first, sizes, axis=1)
            good = (c != ids) & _possible(cn, cat, n, at, percent)
            found = [np.stack([np.zeros(good.sum(), dtype=np.int64), c[good], ids[good]])]
            size = np.repeat(sizes, sizes)
            place = np.arange(len(keys)) - np.repeat(starts, sizes)
            short = np.full(len(keys), not part) & (size <= SHORT_LIST)
            left = np.flatnonzero(short & (place > 0))
            for step in range(1, SHORT_LIST):
                left = left[place[left] + step < size[left]]
                right = left + step
                good = (ids[left] != ids[right]) & _possible(n[left], at[left], n[right], at[right], percent)
                found.append(np.stack([np.ones(good.sum(), dtype=np.int64), ids[left[good]], ids[right[good]]]))
            named, a, b = np.concatenate(found, axis=1)
            yield pd.DataFrame({"named": named, "a": a, "b": b, "key": 0, "n": 0, "at": 0}).drop_duplicates()
            if not short.all():
                long = rows[~short]
                yield pd.DataFrame({"named": 2, "a": long["id"], "b": 0, "key": long["key"], "n": long["n"], "at": long["at"]})
    return pairs


def _meeting(labels: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, list]:
    """Which documents of a list have a possible partner of another label there, and the pairs if they are few.

    All but the most common label are compared with the list; if that is too much, all count.
    """
    names, counts = np.unique(labels, return_counts=True)
    few = np.flatnonzero(labels != names[counts.argmax()])
    there = np.zeros(len(labels), dtype=bool)
    if len(few) * len(labels) > COMPARED:
        return ~there, []
    pairs, met_pairs = [], 0
    for part in np.array_split(few, max(1, -(-len(few) * len(labels) // (1 << 20)))):
        met = (labels[part][:, None] != labels) & _possible(n[part][:, None], at[part][:, None], n, at, percent)
        there[part] |= met.any(axis=1)
        there |= met.any(axis=0)
        met_pairs += int(met.sum())
        if met_pairs <= NAMED * len(labels):
            left, right = np.nonzero(met)
            pairs.append((part[left], right))
    return there, pairs if met_pairs <= NAMED * len(labels) else []


def _crossing(percent: int):
    """(cell, id, label, other) of documents with a possible partner of another label in a list: `other`, if pairs are few."""
    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, part in by_key(batches, LONG_LIST):
            if part:  # a long list: all its documents meet in a cell of their own
                yield pd.DataFrame({"cell": rows["key"], "id": rows["id"], "label": rows["label"], "other": pd.array(
                    [None] * len(rows), dtype="Int64")})
                continue
            keys, labels = rows["key"].to_numpy(), rows["label"].to_numpy()
            starts, sizes = groups(keys)
            mixed = np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts)
            n, at, ids = rows["n"].to_numpy(), rows["at"].to_numpy(), rows["id"].to_numpy()
            out = []
            for s, size in zip(starts[mixed], sizes[mixed]):
                g = slice(s, s + size)
                there, pairs = _meeting(labels[g], n[g], at[g], percent)
                for left, right in pairs:
                    out.append(pd.DataFrame({"cell": 0, "id": ids[g][left], "label": labels[g][left],
                                             "other": pd.array(ids[g][right], dtype="Int64")}))
                if there.any() and not pairs:
                    out.append(pd.DataFrame({"cell": labels[g].min(), "id": ids[g][there], "label": labels[g][there],
                                             "other": pd.array([None] * int(there.sum()), dtype="Int64")}))
            if out:
                yield pd.concat(out).drop_duplicates()
    return cross


def _links(size_a: int, size_b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (size_a + size_b - shared)


def divide_skip(query: np.ndarray, lists: dict[int, list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(number, overlap) of the indexed sets that share at least `least` elements with the query.

    The longest lists are set aside, the others merged with a heap; a number that occurs
    there often enough is looked up in the long lists by binary search.
    """
    found = sorted((lists[x] for x in query.tolist() if x in lists), key=len)
    if len(found) < least:
        return
    aside = min(least - 1, max(0, len(found) - 1), least // 2 + sum(len(x) > 64 for x in found) // 2)
    short, long = found[:len(found) - aside], found[len(found) - aside:]
    count, last = 0, None
    for number in heapq.merge(*short, (1 << 62,)):
        if number == last:
            count += 1
            continue
        if last is not None and count >= least - aside:
            total = count
            for tried, entries in enumerate(long):
                if total + len(long) - tried < least:
                    break
                place = bisect_left(entries, last)
                total += place < len(entries) and entries[place] == last
            if total >= least:
                yield last, total
        last, count = number, 1


def search_cell(indexed: list[tuple[int, int, np.ndarray]], queries: list[tuple[int, int, np.ndarray]],
                percent: int) -> list[tuple[int, int]]:
    """Links that join all labels of (id, label, set) which links between queries and index join."""
    lists: dict[int, list[int]] = {}
    for number, (_, _, s) in enumerate(indexed):
        for x in s.tolist():
            lists.setdefault(x, []).append(number)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for id, label, s in queries:
        for number, shared in divide_skip(s, lists, _ceil(percent * len(s), 100)):
            other, other_label, t = indexed[number]
            if root(label) != root(other_label) and _links(len(s), len(t), shared, percent):
                parent[root(label)] = root(other_label)
                out.append((id, other))
    return out


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, grams) of the documents named in `ids`, once per id and set."""
    wanted = store(ids.select(F.col("id").alias("wanted")).distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "grams": [shingles(t, width).tobytes() for t in batch["text"]]})

    rows = docs.join(wanted, F.col("id") == F.col("wanted"), "left_semi")
    return rows.mapInPandas(build, "id bigint, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def link(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            small, large = (x, y) if len(x) < len(y) else (y, x)
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            out.append(_links(len(x), len(y), int((large[place] == small).sum()), percent))
        return pd.Series(out, dtype="bool")

    first = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    second = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(second, "b").join(first, "a").where(link("grams_a", "grams_b")).select("a", "b").distinct()


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH,
         percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: (id, n_shingles, first) per row, `first` the smallest id with the same
    set, null for empty sets. links: (a, b) between different sets that connect all that link."""
    spark = docs.sparkSession
    rows = docs.select(col(id).cast("bigint").alias("id"), col(text).alias("text"))
    scanned = store(rows.mapInArrow(
        _scan(width), "id bigint, n bigint, mark binary, sign binary, part int, counters binary"), "sets")
    summed = scanned.where("part IS NOT NULL").select("part", "counters").groupBy("part").applyInPandas(
        _sum_counters, "part int, counters binary").collect()  # COUNTERS numbers, whatever the input
    counters = np.zeros(COUNTERS, dtype=np.uint64)
    for part, data in summed:
        size = COUNTERS // COUNTER_PARTS
        counters[part * size:(part + 1) * size] = np.frombuffer(bytes(data), dtype=np.uint64)
    counters = spark.sparkContext.broadcast(counters)

    light = scanned.where("part IS NULL").select("id", "n", "mark")
    same = store(light.where("mark IS NOT NULL AND id IS NOT NULL").groupBy("mark").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    marked = join_by_key(light.where("mark IS NOT NULL AND id IS NOT NULL"), same, ["mark"], "copies")
    members = store(marked.select("id", "n", "first").unionByName(
        light.where("mark IS NULL OR id IS NULL").select("id", "n", F.lit(None).cast("bigint").alias("first"))))
    firsts = members.where("first IS NOT NULL").select("id", "first").distinct()

    known = rows.where("id IS NOT NULL")
    entries = known.mapInArrow(_lists(counters, width, percent), "key bigint, id bigint, n int, at int")
    shared = store(entries.repartition("key").sortWithinPartitions("key").mapInPandas(
        _shared, "key bigint, id bigint, n int, at int"), "lists")

    def by_first(pairs: DataFrame) -> DataFrame:
        for name in ("a", "b"):
            to = firsts.select(F.col("id").alias(name), F.col("first").alias("to"))
            pairs = pairs.join(to, name).drop(name).withColumnRenamed("to", name)
        return pairs.where("a <> b").distinct()

    signs = store(scanned.where("mark IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id", "mark"]).select(
        "id", "n", "sign"), "signs")

    @F.pandas_udf("boolean")
    def allow(n1: pd.Series, sign1: pd.Series, n2: pd.Series, sign2: pd.Series) -> pd.Series:
        return pd.Series([signs_allow(*x, percent) for x in zip(n1, sign1, n2, sign2)], dtype="bool")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs whose signs allow a link; rows that share an id are all tried."""
        for name in ("a", "b"):
            pairs = pairs.join(signs.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"),
                                            F.col("sign").alias(f"sign_{name}")), name)
        return pairs.where(allow("n_a", "sign_a", "n_b", "sign_b")).drop("n_a", "sign_a", "n_b", "sign_b").distinct()

    possible = store(shared.repartition("key").sortWithinPartitions("key", "id").mapInPandas(
        _pairs(percent), "named int, a bigint, b bigint, key bigint, n int, at int"), "pairs")
    named = possible.where("named < 2").groupBy("a", "b").agg(F.min("named").alias("named"))
    pairs = store(allowed(by_first(named).groupBy("a", "b").agg(F.min("named").alias("named"))))
    centred = pairs.where("named = 0").select("a", "b")
    sets = _sets(known, centred.select(F.col("a").alias("id")).union(centred.select("b")), width)
    near = store(_verified(centred, sets, percent))

    # A label is an id that the document is connected with: the smallest centre, taken twice.
    centre = near.groupBy("b").agg(F.min("a").alias("a"))
    up = centre.select(F.col("b").alias("a"), F.col("a").alias("above"))
    hop = centre.join(up, "a", "left").select("b", F.coalesce("above", "a").alias("label"))
    labels = store(firsts.join(hop, F.col("first") == F.col("b"), "left").select(
        "id", "first", F.coalesce("label", "first").alias("label")))
    open_lists = possible.where("named = 2").select("key", F.col("a").alias("id"), "n", "at").join(labels, "id").select(
        "key", F.col("first").alias("id"), "n", "at", "label")
    crossing = store(open_lists.repartition("key").sortWithinPartitions("key", "id").mapInPandas(
        _crossing(percent), "cell bigint, id bigint, label bigint, other bigint").distinct())
    others = allowed(crossing.where("other IS NOT NULL").select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    others = pairs.where("named = 1").select("a", "b").unionByName(others).distinct()
    of_first = labels.select("first", "label").distinct()
    for name in ("a", "b"):
        others = others.join(of_first.select(F.col("first").alias(name), F.col("label").alias(f"label_{name}")), name)
    others = store(others.where("label_a <> label_b"))
    cell = F.least("label_a", "label_b").alias("cell")
    cells = store(crossing.where("other IS NULL").select("cell", "id", "label").unionByName(
        others.select(cell, F.col("a").alias("id"), F.col("label_a").alias("label"))).unionByName(
        others.select(cell, F.col("b").alias("id"), F.col("label_b").alias("label"))).distinct())
    sizes = cells.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(
        F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("common"))
    sizes = store(sizes)
    placed = cells.join(sizes, "cell").withColumn("asks", F.col("label") != F.col("common"))
    blocks = F.ceil(F.col("n") / INDEX_BLOCK).cast("int")
    query_blocks = F.ceil(F.col("n") / QUERY_BLOCK).cast("int")
    mine, asked = F.pmod(F.xxhash64("id"), blocks), F.pmod(F.xxhash64("id", F.lit(1)), query_blocks)

    def every(n):
        return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)

    index_side = placed.select("cell", "id", "label", F.lit(False).alias("asks"), mine.alias("block"),
                               F.explode(every(query_blocks)).alias("query_block"))
    query_side = placed.where("asks").select(
        "cell", "id", "label", "asks", F.explode(every(blocks)).alias("block"), asked.alias("query_block"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in by_key(batches, 1 << 30):  # a key has two blocks at most
            starts, sizes = groups(rows["key"].to_numpy())
            every_row = list(zip(rows["asks"].tolist(), rows["id"].tolist(), rows["label"].tolist(), rows["grams"]))
            out = []
            for s, size in zip(starts.tolist(), sizes.tolist()):
                sides = {True: [], False: []}
                for asks, id, label, grams in every_row[s:s + size]:
                    sides[asks].append((id, label, np.frombuffer(grams, dtype=np.uint64)))
                out += search_cell(sides[False], sides[True], percent)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    sides = index_side.unionByName(query_side).withColumn("key", F.xxhash64("cell", "block", "query_block"))
    far = sides.join(_sets(known, cells.select("id"), width), "id").select("key", "id", "label", "asks", "grams")
    far = far.repartition("key").sortWithinPartitions("key", "id").mapInPandas(search, "a bigint, b bigint")
    links = store(near.unionByName(far), "links")
    return members.select("id", F.col("n").alias("n_shingles"), "first"), links


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id) per row: the smallest id that links lead to."""
    members, links = join(docs, id, text, **options)
    found = components(links).withColumnRenamed("node", "first")
    sizes = members.where("first IS NOT NULL").groupBy("first").agg(F.count(F.lit(1)).alias("rows"))
    joined = join_by_key(members.where("first IS NOT NULL"), sizes.join(found, "first", "left"), ["first"], "rows")
    alone = members.where("first IS NULL").withColumn("component", F.col("id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id), "n_shingles", F.coalesce("component", "first", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of every component the document with the smallest id; rows without an id stay.

    Rows that share an id are documents of their own if their texts differ, the one with the lower digest
    first. Of rows with one id and one text one stays, the lowest by a hash of all columns; without a word
    in the text only rows equal in all columns are dropped.
    """
    known = docs.where(col(id).isNotNull())
    again = known.groupBy(col(id).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if again.isEmpty():
        return _smallest(docs, id, text, **options)
    every = F.xxhash64(*[col(c) for c in flat_columns(docs)])
    blank = ~F.coalesce(col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = known.withColumns({"_digest": F.sha2(F.coalesce(col(text), F.lit("")), 256), "_row": every})
    first = Window.partitionBy(col(id), "_digest", F.when(blank, F.col("_row"))).orderBy("_row")
    rows = rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    keys = rows.select(col(id).alias("_id"), "_digest").distinct()
    nodes = store(dense_position(keys, ["_id", "_digest"], name="_node")).withColumnRenamed("_digest", "_its")
    numbered = store(rows.join(nodes, (col(id) == F.col("_id")) & (F.col("_digest") == F.col("_its"))).select(
        *[col(c) for c in docs.columns], "_node"))
    left = _smallest(numbered, "_node", text, **options).drop("_node")
    return left.unionByName(docs.where(col(id).isNull()))


def _smallest(docs: DataFrame, node: str, text: str, **options) -> DataFrame:
    gone = store(grouped(docs, node, text, **options).where(f"`{node}` <> component_id").select(
        col(node).alias("_gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, col(node) == F.col("_gone"), "left_anti")
