"""Repeated passages by a common-prefix interval tree over suffixes.

A string of `least` bytes that starts at two places is repeated; the bytes that repeated
strings cover are removed. Strings stay within a text.

1. Anchors. Of every `least` bytes the GRAM-byte piece with the smallest hash (the first
   of equals) is an anchor, so equal strings have an anchor at the same offset. A piece
   that is an anchor once only belongs to no repeat.
2. Suffixes. Around every other anchor go the bytes of all strings that it can stand for:
   up to `least` from it on, and up to `least - GRAM` before it. Suffixes that start with
   the same piece meet in one task.
3. Tree. A task sorts its suffixes, computes the common prefixes of neighbours and scans
   them with a stack into the intervals of the common-prefix tree. In every interval the
   suffixes are sorted by what stands to their left, and neighbours compared: where the
   left extensions differ a maximal repeat ends. Suffixes that share a left extension l in
   an interval with prefix r, l + r >= least, are the occurrences of a maximal repeat of
   length l + r; all of them are given, each at its own place.
4. The union of all occurrences is removed.

Equal surroundings are one suffix, in the task that cuts them and in the tree. A piece with more than LONG suffixes is not held in
one task: its suffixes meet by longer pieces, and those of a longer piece that is crowded
too have every string around them counted by digest, which is the same test for each
single string. Equal texts in one task are repeats as a whole.

Null texts are empty; texts shorter than `least` bytes have no repeats of their own.
Repeated rows are repeats of each other. Rows that share an id but not the text are told
apart. Other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.llm.hashing import mix, prefix_sums, span_hashes, window_minima
from quiltframe.llm.runs import by_key, groups
from quiltframe.operators.scratch import store

LEAST, GRAM = 200, 56
LONG = 50_000
BROADCAST_SPANS = 2_000_000
MOST_AROUND = 300_000
OUT = ["key", "id", "mark", "at", "left", "right", "start", "stop"]
PLACE_BITS = np.uint64(0xFFFFFFFF)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _mark(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def anchors(data: bytes, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of a text's anchors."""
    if len(data) < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    array = np.frombuffer(data, dtype=np.uint8)
    starts = np.arange(len(array) - gram + 1)
    hashed = span_hashes(prefix_sums(array), starts, starts + gram)
    ranked = (mix(hashed) & ~PLACE_BITS) | starts.astype(np.uint64)
    lowest = window_minima(ranked, least - gram + 1)
    places = (lowest[np.r_[True, lowest[1:] != lowest[:-1]]] & PLACE_BITS).astype(np.int64)
    return hashed[places].view(np.int64), places


def _anchor_keys(least: int, gram: int):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(anchors(_bytes(t), least, gram)[0], return_counts=True) for t in batch["text"]]
            if found:
                yield pd.DataFrame({
                    "id": np.repeat(batch["id"].to_numpy(), [len(k) for k, _ in found]),
                    "key": np.concatenate([k for k, _ in found]), "n": np.concatenate([n for _, n in found])})
    return keys


def _suffixes(least: int, gram: int):
    """Surroundings of the anchors whose keys are in `keys`, and whole texts met before in the task."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int | None] = {}
        around: dict[bytes, tuple] = {}
        columns = ["key", "id", "mark", "at", "left", "right", "start"]
        for batch in batches:
            out = []
            if len(around) > MOST_AROUND:
                around.clear()
            for id, text, wanted in zip(batch["id"], batch["text"], batch["keys"]):
                data = _bytes(text)
                mark = _mark(data)
                if mark in seen:
                    # Key null: the span [start, at) is a repeat, here and at the first copy.
                    for other in {id, seen[mark]} if len(data) >= least else ():
                        out.append((None, other, mark, len(data), None, None, 0))
                    continue
                seen[mark] = id
                keys, places = anchors(data, least, gram)
                met = np.isin(keys, wanted)
                for key, at in zip(keys[met].tolist(), places[met].tolist()):
                    start, stop = max(0, at - least + gram), min(len(data), at + least)
                    place = (None, id, mark, stop, None, None, start)
                    # Surroundings met before in this task go on only once.
                    digest = hashlib.blake2b(data[start:stop], digest_size=16, salt=(at - start).to_bytes(4)).digest()
                    first = around.get(digest)
                    if first is None or stop - start < least:
                        around[digest] = place
                        out.append((key, id, mark, at, data[start:at][::-1], data[at:stop], -1))
                    else:
                        out.append(place)
                        if first:
                            out.append(first)
                            around[digest] = ()
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"key": "Int64", "id": "Int64", "at": "Int64", "start": "Int64"})
    return cut


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes plus one, 0 after the end; lengths. UTF-8 has no byte 255."""
    flat = np.frombuffer(b"".join(t.ljust(width, b"\xff") for t in texts), dtype=np.uint8)
    return (flat + np.uint8(1)).reshape(len(texts), width), np.array([len(t) for t in texts], dtype=np.int64)


def _order(matrix: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")


def common_prefixes(matrix: np.ndarray, lengths: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of rows."""
    out = np.empty(len(first), dtype=np.int64)
    for part in range(0, len(first), 8192):
        a, b = first[part:part + 8192], second[part:part + 8192]
        differ = matrix[a] != matrix[b]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        out[part:part + 8192] = np.minimum(at, np.minimum(lengths[a], lengths[b]))
    return out


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(prefix, low, high) of the nodes of the common-prefix tree with prefix >= least, children first.

    lcp[i] is the common prefix of sorted suffixes i and i + 1; high is inclusive.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), -1]):
        low = i
        while stack and stack[-1][0] > value:
            prefix, low = stack.pop()
            yield prefix, low, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, low))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(members, extensions, prefix) per interval: occurrences reach `extensions` to the left, `prefix` to the right.

    left texts are reversed. Members share the longest left extension they have with any
    other member; those of less than least - prefix are no members.
    """
    after, after_n = _matrix(right, least)
    before, before_n = _matrix(left, least - gram)
    order = _order(after)
    lcp = common_prefixes(after, after_n, order[:-1], order[1:])
    near = common_prefixes(before, before_n, order[:-1], order[1:])
    rank = np.empty(len(order), dtype=np.int64)
    rank[_order(before)] = np.arange(len(order))
    for prefix, low, high in intervals(lcp, gram):
        if high == low + 1:
            if near[low] + prefix >= least:
                yield order[low:high + 1], np.array([near[low]] * 2), prefix
            continue
        members = order[low:high + 1]
        members = members[np.argsort(rank[members])]
        shared = common_prefixes(before, before_n, members[:-1], members[1:])
        extension = np.maximum(np.r_[shared, -1], np.r_[-1, shared])
        good = extension + prefix >= least
        if good.any():
            yield members[good], extension[good], prefix


def _tree(least: int, gram: int, long: int):
    """Spans of repeats; rows of a piece with too many suffixes come out as they are."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, part in by_key(batches, long):
            if part:
                yield rows.assign(start=-1, stop=-1)[OUT]
                continue
            rows = rows.reset_index(drop=True)
            starts, sizes = groups(rows["key"].to_numpy())
            number = np.repeat(np.arange(len(starts)), sizes)
            # Equal surroundings are one suffix; with two of them all of it is repeated.
            same = rows.assign(number=number).groupby(["number", "left", "right"], sort=False)
            which, copies = same.ngroup().to_numpy(), same["at"].transform("size").to_numpy()
            firsts = np.flatnonzero(np.r_[True, which[1:] > np.maximum.accumulate(which)[:-1]])
            left, right = rows["left"].tolist(), rows["right"].tolist()
            ids, marks, at = rows["id"].to_numpy(), rows["mark"].to_numpy(), rows["at"].to_numpy()
            reach = np.array([[len(a), len(b)] for a, b in zip(left, right)]).reshape(-1, 2)
            whole = (copies > 1) & (reach.sum(axis=1) >= least)
            out = [(ids[whole], marks[whole], (at - reach[:, 0])[whole], (at + reach[:, 1])[whole])]
            # Only pieces with different surroundings need the tree.
            kinds = np.bincount(number[firsts], minlength=len(starts))
            chosen = firsts[kinds[number[firsts]] > 1]
            if len(chosen):
                for members, extension, prefix in maximal_repeats(
                        [left[i] for i in chosen], [right[i] for i in chosen], least, gram):
                    i = chosen[members]
                    out.append((ids[i], marks[i], at[i] - extension, at[i] + prefix))
            yield pd.DataFrame({
                "key": None, "id": np.concatenate([o[0] for o in out]), "mark": np.concatenate([o[1] for o in out]), "at": -1,
                "left": None, "right": None, "start": np.concatenate([o[2] for o in out]),
                "stop": np.concatenate([o[3] for o in out])})
    return scan


def _strings(least: int, gram: int):
    """Digest and place of every string around an anchor."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 500):
                out = []
                for id, mark, at, left, right in zip(*(batch[c].iloc[part:part + 500] for c in (
                        "id", "mark", "at", "left", "right"))):
                    data = bytes(left)[::-1] + bytes(right)
                    out += [(id, mark, at - len(left) + i, _mark(data[i:i + least]))
                            for i in range(min(len(left) + 1, len(data) - least + 1))]
                yield pd.DataFrame(out, columns=["id", "mark", "start", "digest"]).astype({"id": "Int64"})
    return cut


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST,
                   gram: int = GRAM, long: int = LONG) -> DataFrame:
    """(id, mark, start, stop): byte spans that hold all repeated strings; mark tells texts of one id apart."""
    rows = docs.select(col(id).cast("bigint").alias("id"), col(text).alias("text"))
    found = rows.mapInPandas(_anchor_keys(least, gram), "id bigint, key bigint, n bigint")
    often = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    wanted = found.select("id", "key").join(often, "key", "left_semi").groupBy("id").agg(
        F.collect_set("key").alias("keys")).withColumnRenamed("id", "wanted")  # at most the anchors of a text
    cut = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted"))).select("id", "text", "keys").mapInPandas(
        _suffixes(least, gram),
        "key bigint, id bigint, mark binary, at bigint, left binary, right binary, start bigint")
    # Whole texts have no key; they pass through with the trees' spans.
    spans, crowd = _in_trees(cut, least, gram, long)
    if crowd.isEmpty():
        return spans
    # Strings of `least` bytes share half of what stands around the piece, on one side at least:
    # crowded suffixes meet again by either half. A half that occurs once joins no string.
    half = (least - gram) // 2
    halves = F.array(
        F.when(F.octet_length("right") >= gram + half, F.xxhash64(F.substring("right", 1, gram + half))),
        F.when(F.octet_length("left") >= half, F.xxhash64(F.lit(1), "key", F.substring("left", 1, half))))
    halved = crowd.withColumn("half", F.explode(halves)).where("half IS NOT NULL")
    often = halved.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    again = halved.join(often, "half", "left_semi").drop("key").withColumnRenamed("half", "key")
    more, crowd = _in_trees(again.select(*cut.columns), least, gram, long)
    spans = spans.unionByName(more)
    if crowd.isEmpty():
        return spans
    strings = crowd.select("id", "mark", "at", "left", "right").distinct().mapInPandas(
        _strings(least, gram), "id bigint, mark binary, start bigint, digest binary").distinct()
    twice = strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = strings.join(twice, "digest", "left_semi").select(
        "id", "mark", "start", (F.col("start") + least).alias("stop"))
    return spans.unionByName(counted)


def _in_trees(cut: DataFrame, least: int, gram: int, long: int) -> tuple[DataFrame, DataFrame]:
    """Spans of repeats, and the suffixes of crowded pieces."""
    # Whole texts have no key; they pass through with the trees' spans.
    found = store(cut.repartition(F.coalesce("key", F.xxhash64("id"))).sortWithinPartitions("key").mapInPandas(
        _with_whole(_tree(least, gram, long)),
        "key bigint, id bigint, mark binary, at bigint, left binary, right binary, start bigint, stop bigint"), "repeats")
    return (found.where("key IS NULL").select("id", "mark", "start", "stop"),
            found.where("key IS NOT NULL").drop("stop"))


def _with_whole(scan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = []

        def keyed():
            for batch in batches:
                copy = batch["key"].isna()
                if copy.any():
                    whole.append(batch[copy][["id", "mark", "start", "at"]])
                    batch = batch[~copy]
                yield batch.astype({"key": "int64"})

        for out in scan(keyed()):
            yield out.astype({"key": "Int64", "id": "Int64"})
        for rows in whole:
            yield pd.DataFrame({"key": pd.array([None] * len(rows), dtype="Int64"),
                                "id": rows["id"].astype("Int64").to_numpy(), "mark": rows["mark"].to_numpy(), "at": -1, "left": None,
                                "right": None, "start": rows["start"].astype("int64").to_numpy(), "stop": rows["at"].astype("int64").to_numpy()}) \
                .astype({"id": "Int64"})
    return run


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined."""
    def step(done, span):
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (last["stop"] >= span["start"]), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.concat(done, F.array(span)))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept: the remaining bytes."""
    spans = repeated_spans(docs, id, text, **options)
    # A text's spans, at most a few per anchor, merged to its maximal runs.
    runs = spans.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"))
    per_doc = store(runs.select("id", "mark", _merged(F.col("s")).alias("s")).groupBy("id").agg(
        F.collect_list(F.struct("mark", "s")).alias("texts")).withColumnRenamed("id", "span_id"), "spans")
    if per_doc.select(F.coalesce(F.sum(F.aggregate(
            "texts", F.lit(0), lambda n, t: n + F.size(t["s"]))), F.lit(0))).first()[0] <= BROADCAST_SPANS:
        per_doc = F.broadcast(per_doc)
    rows = docs.select(col(id).cast("bigint").alias("id"), col(text).alias("text"))
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("span_id")), "left").select("id", "text", "texts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id, text, texts in zip(batch["id"], batch["text"], batch["texts"]):
                data = _bytes(text)
                mine = [] if texts is None else next((t["s"] for t in texts if bytes(t["mark"]) == _mark(data)), [])
                kept, at, runs, end = [], 0, 0, -1
                for start, stop in sorted((s["start"], s["stop"]) for s in mine):
                    runs += start > end
                    if start > at:
                        kept.append(data[at:start])
                    at, end = max(at, stop), max(end, stop)
                rest = b"".join(kept) + data[at:]
                out.append((id, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]) \
                .astype({"id": "Int64"})

    return joined.mapInPandas(
        cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    ).withColumnRenamed("id", id)
