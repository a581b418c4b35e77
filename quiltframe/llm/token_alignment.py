"""Alignment of two tokenizers over whole texts, and how often their ids meet.

Both tokenizers encode " " + text. The byte offsets where tokens of both end cut
the text into groups; every overlap of a token of A with one of B is a link.
Between two neighbouring ends, of either side, lies exactly one link.

Long texts are cut into byte ranges. A range sees the words around its edges and
keeps the tokens that end inside it; what it knows is a *fragment*: an open
prefix (tokens up to the first common end), closed groups, and an open suffix
(tokens behind the last one). Two neighbouring fragments compose to one:
suffix and prefix between them close one group, and nothing else changes, so
composition is associative and runs as a tree over Spark tasks. Only open tokens
travel up the tree; closed groups are written where they close. Short texts are
one range.

Counts of id pairs are sums over documents. Documents are gathered in packets of
a bounded number of links; a packet sends each of its distinct pairs once, with
the number of its documents that hold it, and gets back the pair's count over
all documents. No task or driver holds the pairs of the corpus.

Cases. NULL or empty texts, and texts that one of the tokenizers does not give
back byte by byte, have no tokens: zeros and the empty digest. Repeated rows
(also of one doc_id, or of none) are documents of their own and count each. An
empty table gives no rows. Other columns are ignored. Ties for the highest count
are all best.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.llm import encoders
from quiltframe.llm.encoders import Encoders
from quiltframe.operators.scratch import store

RANGE = 32_768        # bytes of a text that one task aligns at once
FAN = 8               # neighbouring fragments composed by one call
PACKET = 2_000_000    # distinct (document, pair) links gathered in one packet
BATCH = 1_000_000     # characters aligned at once inside a task

NONE = np.zeros(0, np.int64)


# --- Tokens and their alignment --------------------------------------------

@dataclass
class Tokens:
    """Ids of both sides and the byte offsets at which they end."""
    a: np.ndarray = field(default_factory=lambda: NONE)
    ends_a: np.ndarray = field(default_factory=lambda: NONE)
    b: np.ndarray = field(default_factory=lambda: NONE)
    ends_b: np.ndarray = field(default_factory=lambda: NONE)

    def __add__(self, other: "Tokens") -> "Tokens":
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.ends_a, self.b, self.ends_b

    def between(self, low: int, high: int) -> "Tokens":
        """The tokens that end in (low, high]."""
        i, j = np.searchsorted(self.ends_a, [low, high], "right")
        k, m = np.searchsorted(self.ends_b, [low, high], "right")
        return Tokens(self.a[i:j], self.ends_a[i:j], self.b[k:m], self.ends_b[k:m])


class Alignment:
    """Links and groups of tokens whose first ones start at `start` and whose last ones end together."""

    def __init__(self, tokens: Tokens, start: int = 0):
        self.tokens, self.start = tokens, start
        total = int(tokens.ends_a[-1]) - start if len(tokens.ends_a) else 0
        mark = np.zeros(total + 1, np.uint8)
        mark[tokens.ends_a - start] = 1
        mark[tokens.ends_b - start] += 2
        self.ends = np.flatnonzero(mark)
        kind = mark[self.ends]
        self.upto_a, self.upto_b = (np.cumsum(x, dtype=np.int64) for x in (kind & 1, kind >> 1))
        # A link belongs to the first tokens that end at or behind its end.
        self.of_a, self.of_b = self.upto_a - (kind & 1), self.upto_b - (kind >> 1)
        self.closing = np.flatnonzero(kind == 3)

    def cuts(self, ends: np.ndarray) -> np.ndarray:
        """The number of links that end at or before the given offsets."""
        return np.searchsorted(self.ends, ends - self.start, "right")

    def keys(self, width: int) -> np.ndarray:
        """The id pair of every link as one number."""
        return self.tokens.a[self.of_a].astype(np.int64) * width + self.tokens.b[self.of_b]

    def written(self, enc: Encoders, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes `a1,a2|b1;a3|b2,b3` of all groups, and where each group ends in them.

        `last` marks the groups that no separator follows.
        """
        done_a, done_b = self.upto_a[self.closing], self.upto_b[self.closing]
        n_a, n_b = np.diff(done_a, prepend=0), np.diff(done_b, prepend=0)
        at_a = np.arange(len(self.tokens.a)) + np.repeat(done_b - n_b, n_a)
        at_b = np.arange(len(self.tokens.b)) + np.repeat(done_a, n_b)
        wide_a, wide_b = enc.digits_a.shape[1], enc.digits_b.shape[1]
        cells = np.zeros((len(at_a) + len(at_b), max(wide_a, wide_b)), np.uint8)
        cells[at_a, :wide_a] = enc.digits_a[self.tokens.a]
        cells[at_b, :wide_b] = enc.digits_b[self.tokens.b]
        cells[:, -1] = ord(",")
        cells[at_a[done_a - 1], -1] = ord("|")
        cells[at_b[done_b - 1], -1] = np.where(last, 0, ord(";"))
        flat = cells.ravel()
        sizes = np.cumsum((cells != 0).sum(axis=1))
        return flat[flat != 0], sizes[at_b[done_b - 1]] if len(done_b) else NONE


def tokens_of(enc: Encoders, units: np.ndarray, start: int = 0) -> Tokens:
    a, b = enc.ids_a.fetch(units), enc.ids_b.fetch(units)
    return Tokens(a, start + np.cumsum(enc.width_a[a]), b, start + np.cumsum(enc.width_b[b]))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    keys = np.sort(keys)
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else NONE
    return keys[firsts], np.diff(np.r_[firsts, len(keys)])


# --- Packets ----------------------------------------------------------------

PACKET_ROW = ("packet long, doc_id array<long>, sizes array<array<long>>, digest array<string>, ends array<long>, "
              "codes binary, times binary, pairs array<long>, holds array<int>")


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view("<u4").ravel()


class Packer:
    """Gathers documents; gives a packet whenever enough links have come together."""

    def __init__(self, sign: int, most: int):
        self.sign, self.most, self.made = sign, most, 0
        self._clear()

    def _clear(self) -> None:
        self.docs, self.pairs, self.times, self.links = [], [], [], 0

    def add(self, doc_id, sizes: list[int], digest: str, pairs: np.ndarray, times: np.ndarray) -> None:
        """A document; `pairs` are its distinct id pairs in order, `times` their links."""
        self.docs.append((doc_id, sizes, digest, len(pairs)))
        self.pairs.append(pairs)
        self.times.append(times)
        self.links += len(pairs)

    def packet(self) -> Iterator[pd.DataFrame]:
        if not self.docs:
            return
        pairs, codes, holds = np.unique(np.concatenate(self.pairs or [NONE]), return_inverse=True, return_counts=True)
        ends = np.cumsum([d[3] for d in self.docs])
        # Within a document the codes rise: steps are small numbers.
        steps = np.diff(codes, prepend=0)
        firsts = np.r_[0, ends[:-1]]
        firsts = firsts[firsts < len(codes)]
        steps[firsts] = codes[firsts]
        number = (TaskContext.get().partitionId() << 32) + self.made
        yield pd.DataFrame([{
            "packet": self.sign * (number + 1), "doc_id": [d[0] for d in self.docs],
            "sizes": [d[1] for d in self.docs], "digest": [d[2] for d in self.docs], "ends": ends,
            "codes": _packed(steps), "times": _packed(np.concatenate(self.times or [NONE])),
            "pairs": pairs, "holds": holds.astype(np.int32)}])
        self.made += 1
        self._clear()

    def full(self) -> Iterator[pd.DataFrame]:
        if self.links >= self.most or len(self.docs) >= self.most // 10:
            yield from self.packet()


def _ids(values: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in values]


def _short_packets(folder: str, most: int):
    """Documents of one range each: encode, align, pack."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, packer = encoders.load(folder), Packer(1, most)
        for batch in batches:
            ids, texts = _ids(batch["doc_id"]), [t if isinstance(t, str) else "" for t in batch["text"]]
            reach = np.cumsum([len(t) for t in texts]) // BATCH
            for low, high in zip(*_runs(reach)):
                _align_documents(enc, packer, ids[low:high], texts[low:high])
                yield from packer.full()
        yield from packer.packet()
    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def _align_documents(enc: Encoders, packer: Packer, ids: list, texts: list[str]) -> None:
    units = enc.units(texts)
    good = [bool(t) and bool(enc.sound[u].all()) for t, u in zip(texts, units)]
    kept = [u for u, g in zip(units, good) if g]
    if kept:
        codes = np.concatenate(kept)
        tokens = tokens_of(enc, codes)
        n_a = np.add.reduceat(enc.ids_a.sizes[codes], np.r_[0, np.cumsum([len(u) for u in kept])[:-1]])
        found = Alignment(tokens)
        ends = tokens.ends_a[np.cumsum(n_a) - 1]
        links = found.cuts(ends)
        groups = np.searchsorted(found.closing, links, "left")
        last = np.zeros(len(found.closing), bool)
        last[groups - 1] = True
        text, stops = found.written(enc, last)
        stops = np.r_[0, stops[groups - 1]]
        n_b = np.diff(np.r_[0, found.upto_b[links - 1]])
        sizes = np.stack([n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)], axis=1)
        document = np.repeat(np.arange(len(kept)), sizes[:, 3])
        keys, times = counted(document << 32 | found.keys(len(enc.bytes_b)))
        bounds = np.searchsorted(keys >> 32, np.arange(len(kept) + 1))
        keys &= 0xFFFFFFFF
    at = 0
    for doc_id, ok in zip(ids, good):
        if not ok:
            packer.add(doc_id, [0, 0, 0, 0], "", NONE, NONE)
            continue
        low, high = bounds[at], bounds[at + 1]
        digest = hashlib.sha256(text[stops[at]:stops[at + 1]]).hexdigest()
        packer.add(doc_id, sizes[at].tolist(), digest, keys[low:high], times[low:high])
        at += 1


# --- Long texts: fragments and their composition -----------------------------

@dataclass
class Fragment:
    """What a byte range knows: open tokens, and where its last closed group ends (if one does)."""
    prefix: Tokens
    closes: bool = False
    suffix: Tokens = field(default_factory=Tokens)
    edge: int = 0


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Tokens | None]:
    """Two neighbours as one, and the tokens of the group that closes between them.

    Associative: open tokens only move, in order, to the first common end behind them.
    """
    if not right.closes:
        if not left.closes:
            return Fragment(left.prefix + right.prefix), None
        return Fragment(left.prefix, True, left.suffix + right.prefix, left.edge), None
    if not left.closes:
        return Fragment(left.prefix + right.prefix, True, right.suffix, right.edge), None
    return Fragment(left.prefix, True, right.suffix, right.edge), left.suffix + right.prefix


def fragment(tokens: Tokens) -> tuple[Fragment, Tokens | None, int]:
    """The fragment of a range's tokens, the tokens of its closed groups, and where these start."""
    common = np.intersect1d(tokens.ends_a, tokens.ends_b, assume_unique=True)
    if not len(common):
        return Fragment(tokens), None, 0
    first, edge = int(common[0]), int(common[-1])
    closed = tokens.between(first, edge) if edge > first else None
    top = np.iinfo(np.int64).max
    return Fragment(tokens.between(-1, first), True, tokens.between(edge, top), edge), closed, first


_OPEN = [f"{side}_{part}" for side in ("prefix", "suffix") for part in ("a", "ends_a", "b", "ends_b")]
FRAGMENT_ROW = ("doc long, doc_id long, at long, sound boolean, closes boolean, edge long, "
                + ", ".join(f"{n} array<long>" for n in _OPEN)
                + ", sizes array<long>, written binary, pairs array<long>, times array<long>")
WINDOW_ROW = "doc long, doc_id long, at long, low long, high long, start long, text string"


def _allowed(data: bytes, at: int) -> bool:
    """Whether a text may be cut before the space at `at`."""
    if at + 1 >= len(data) or data[at] != 32:
        return False
    first = at - 1
    while first > 0 and data[first] & 0xC0 == 0x80:
        first -= 1
    before = data[first:at].decode("utf-8", "replace")
    after = data[at + 1:at + 5].decode("utf-8", "ignore")[:1]
    return bool(before) and bool(after) and not before.isspace() and not after.isspace()


def _cut_before(data: bytes, at: int) -> int:
    while at > 0:
        at = data.rfind(b" ", 1, at + 1)
        if at <= 0:
            return 0
        if _allowed(data, at):
            return at
        at -= 1
    return 0


def _cut_behind(data: bytes, at: int) -> int:
    while 0 <= at < len(data):
        at = data.find(b" ", at)
        if at < 0:
            break
        if _allowed(data, at):
            return at
        at += 1
    return len(data)


def _windows(size: int):
    """The ranges of every text with the words around their edges."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, doc_id, text in zip(batch["doc"], _ids(batch["doc_id"]), batch["text"]):
                data = b" " + text.encode()
                for at, low in enumerate(range(0, len(data), size)):
                    high = min(low + size, len(data))
                    start, stop = _cut_before(data, low), _cut_behind(data, high)
                    yield pd.DataFrame([(doc, doc_id, at, low, high, start, data[start + 1:stop].decode())],
                                       columns=[c.split()[0] for c in WINDOW_ROW.split(", ")]).astype({"doc_id": "Int64"})
    return run


def _open_row(doc, doc_id, at: int, part: Fragment, sound: bool) -> dict:
    row = {"doc": doc, "doc_id": doc_id, "at": at, "sound": sound, "closes": part.closes, "edge": part.edge}
    return row | dict(zip(_OPEN, [x.astype(np.int64) for x in (*part.prefix.parts(), *part.suffix.parts())]))


def _closed_row(enc: Encoders, doc, doc_id, tokens: Tokens, start: int) -> dict:
    """Closed groups, kept by the offset at which they end."""
    found = Alignment(tokens, start)
    last = np.zeros(len(found.closing), bool)
    last[-1:] = True
    text, _ = found.written(enc, last)
    pairs, times = counted(found.keys(len(enc.bytes_b)))
    return {"doc": doc, "doc_id": doc_id, "at": int(tokens.ends_a[-1]), "sound": True, "closes": None,
            "sizes": [len(tokens.a), len(tokens.b), len(found.closing), len(found.ends)],
            "written": text.tobytes(), "pairs": pairs, "times": times}


def _rows(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in FRAGMENT_ROW.split(", ")]
    return pd.DataFrame([{n: row.get(n) for n in names} for row in rows], columns=names).astype(
        {"doc": "int64", "doc_id": "Int64", "at": "int64", "sound": "boolean", "closes": "boolean", "edge": "Int64"})


def _fragments(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoders.load(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
                units = enc.units([row.text])[0]
                if not enc.sound[units].all():
                    yield _rows([_open_row(row.doc, doc_id, row.at, Fragment(Tokens()), False)])
                    continue
                part, closed, start = fragment(tokens_of(enc, units, row.start).between(row.low, row.high))
                rows = [_open_row(row.doc, doc_id, row.at, part, True)]
                if closed is not None:
                    rows.append(_closed_row(enc, row.doc, doc_id, closed, start))
                yield _rows(rows)
    return run


def _composed(folder: str, root: bool):
    """A run of neighbouring fragments of one text as one; the last round closes the first group."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        enc = encoders.load(folder)
        rows = rows.sort_values("at")
        doc, doc_id = int(key[0]), None if pd.isna(rows["doc_id"].iloc[0]) else int(rows["doc_id"].iloc[0])
        if not rows["sound"].all():
            return _rows([_open_row(doc, doc_id, int(key[1]), Fragment(Tokens()), False)])
        out, whole = [], None
        for row in rows.itertuples(index=False):
            tokens = [np.asarray(getattr(row, n), np.int64) for n in _OPEN]
            part = Fragment(Tokens(*tokens[:4]), bool(row.closes), Tokens(*tokens[4:]), int(row.edge))
            if whole is None:
                whole = part
                continue
            start = whole.edge
            whole, closed = compose(whole, part)
            if closed is not None:
                out.append(_closed_row(enc, doc, doc_id, closed, start))
        if root:
            out.append(_closed_row(enc, doc, doc_id, whole.prefix, 0))
        else:
            out.append(_open_row(doc, doc_id, int(key[1]), whole, True))
        return _rows(out)
    return run


def _reduced(parts: DataFrame, folder: str, fan: int) -> DataFrame:
    """The closed groups of all texts, after a tree of compositions; unsound texts keep an open row."""
    parts = store(parts, "fragments")
    closed = parts.where("closes is null")
    opened = parts.where("closes is not null")
    most = opened.agg(F.max("at")).first()[0]
    while most is not None:
        root = most < fan
        step = opened.withColumn("_run", F.floor(F.col("at") / fan).cast("long"))
        # A fixed number of tasks: rows are few bytes, and composing them costs far more than moving them.
        step = step.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "_run")
        above = store(step.groupBy("doc", "_run").applyInPandas(_composed(folder, root), FRAGMENT_ROW), "fragments")
        closed = closed.unionByName(above.where("closes is null"))
        opened = above.where("closes is not null")
        if root:
            return closed.unionByName(opened)
        most //= fan
    return closed


def _long_packets(most: int):
    """Closed groups sorted by (text, offset): fold each text, then pack it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, now, state = Packer(-1, most), None, None

        def finish():
            digest, sizes, doc_id, pairs, times, sound = state
            keys, sums = _summed(pairs, times)
            if sound:
                packer.add(doc_id, sizes.tolist(), digest.hexdigest(), keys, sums)
            else:
                packer.add(doc_id, [0, 0, 0, 0], "", NONE, NONE)

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.doc != now:
                    if now is not None:
                        finish()
                        yield from packer.full()
                    doc_id = None if pd.isna(row.doc_id) else int(row.doc_id)
                    now, state = row.doc, [hashlib.sha256(), np.zeros(4, np.int64), doc_id, NONE, NONE, True]
                if not row.sound or row.written is None:
                    state[5] = False
                    continue
                if state[1].any():
                    state[0].update(b";")
                state[0].update(row.written)
                state[1] += np.asarray(row.sizes, np.int64)
                state[3] = np.concatenate([state[3], np.asarray(row.pairs, np.int64)])
                state[4] = np.concatenate([state[4], np.asarray(row.times, np.int64)])
                if len(state[3]) > most:
                    state[3], state[4] = _summed(state[3], state[4])
        if now is not None:
            finish()
        yield from packer.packet()
    return run


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys put together, in order."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[firsts], np.add.reduceat(times, firsts)


# --- The operator ------------------------------------------------------------

RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def _scored(key: tuple, packets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The documents of a packet with the counts of their pairs."""
    pairs = pairs.sort_values("pair")
    total, best = pairs["total"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
    out = []
    for row in packets.itertuples(index=False):
        ends = np.asarray(row.ends, np.int64)
        count = int(ends[-1]) if len(ends) else 0
        times = _unpacked(row.times, count).astype(np.int64)
        codes = np.cumsum(_unpacked(row.codes, count).astype(np.int64))
        # Steps restart in every document.
        starts = np.r_[0, ends[:-1]]
        before = np.where(starts > 0, np.r_[0, codes][starts], 0)
        codes -= np.repeat(before, ends - starts)
        sums = [np.r_[0, np.cumsum(times * v[codes])] for v in (best, total)]
        sizes = np.array([list(s) for s in row.sizes], np.int64).reshape(-1, 4)
        out.append(pd.DataFrame({
            "doc_id": pd.array(_ids(pd.Series(list(row.doc_id), dtype="object")), "Int64"),
            **{n: sizes[:, i] for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "n_best": sums[0][ends] - sums[0][starts], "count_sum": sums[1][ends] - sums[1][starts],
            "groups_sha256": list(row.digest)}))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])


def pair_counts(packets: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): documents that hold an id pair, and whether none of its A id has more."""
    held = packets.select(F.explode(F.arrays_zip("pairs", "holds")).alias("x")).select("x.pairs", "x.holds")
    totals = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holds").alias("total"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(width)))  # at most `width` rows
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_a))


def packets_of(docs: DataFrame, folder: str = encoders.FOLDER, size: int = RANGE, fan: int = FAN,
               most: int = PACKET) -> DataFrame:
    """The aligned documents in packets, in the shared folder."""
    rows = docs.select("doc_id", "text")
    long = F.octet_length("text") >= size  # with the space before it, over one range
    short = rows.where(F.col("text").isNull() | ~long).mapInPandas(_short_packets(folder, most), PACKET_ROW)
    windows = rows.where(long).withColumn("doc", F.monotonically_increasing_id()).mapInPandas(_windows(size), WINDOW_ROW)
    parts = windows.repartition("doc", "at").mapInPandas(_fragments(folder), FRAGMENT_ROW)
    closed = _reduced(parts, folder, fan).select("doc", "doc_id", "at", "sound", "sizes", "written", "pairs", "times")
    folded = closed.repartition("doc").sortWithinPartitions("doc", "at").mapInPandas(_long_packets(most), PACKET_ROW)
    return store(short.unionByName(folded), "packets")


def align(docs: DataFrame, folder: str = encoders.FOLDER, size: int = RANGE, fan: int = FAN,
          most: int = PACKET) -> DataFrame:
    """One row per document: tokens, groups, links, and how common the linked id pairs are.

    `size`, `fan` and `most` are the bytes of a range, the fragments composed at once and the links of
    a packet; results do not depend on them.
    """
    packets = packets_of(docs, folder, size, fan, most)
    width = encoders.load(folder).b.get_piece_size()
    asked = packets.select(F.col("packet").alias("asked_by"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(packets, width), "pair")
    sides = packets.drop("pairs", "holds").groupBy("packet"), answers.groupBy("asked_by")
    return sides[0].cogroup(sides[1]).applyInPandas(_scored, RESULT)
