"""Hard negatives for anchors by the Four-Russians scheme: exact integer scores without products.

Components become whole numbers. Eight dimensions form a group. Bit plane b of a
row is the number whose bits are bit b of its components, one byte per group; a
row is its bytes, packed once. For an anchor, a table per group holds the sums of
all 256 subsets of its eight components. The table entry of a plane's byte is the
group's share of that plane, so a score is looked up, shifted by the plane and
added; the top plane, of negative weight, is subtracted.

Rows are packed in blocks, anchors too. Anchors are those rows whose id is
divisible by `every`; rounds of anchor blocks of at most ROUND_BYTES are
broadcast, and each task runs its row blocks past them, keeping only the best of
every anchor. The first pass meets rows of the anchor's label (its positives),
the second rows of other labels within the bounds the positives set.

Cases. Rows with a NULL label, id or vector, or a NULL or non-finite component
take no part. Vectors of unequal length are filled with zeros. Scores are 64-bit
and wrap. Repeated rows each count; rows with an anchor's own id are no partners
of it. Ties go to the smaller id. Anchors without positives, or positives without
negatives, give no rows; an empty table gives none. Other columns are ignored.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.operators.scratch import store

GROUP = 8
ROWS = 2048           # rows of a block
ANCHORS = 256         # anchors of a block
ROUND_BYTES = 32 << 20
AT_ONCE = 64          # anchors whose tables are held at once
SCALE = 256

BLOCK = "block long, ids binary, labels binary, planes binary, bits int, groups int"
ANCHOR_BLOCK = "block long, ids binary, labels binary, parts binary, dims int"
FOUND = "anchor long, anchor_id long, part int, score long, id long"


def whole_numbers(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """floor(256 * x) of every component modulo 2**64, as 64-bit integers."""
    out = np.zeros((len(vectors), dims), np.float64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out = np.floor(out * SCALE)
    sizes = np.fmod(np.abs(out), 2.0 ** 64).astype(np.uint64)
    return np.where(out < 0, np.uint64(0) - sizes, sizes).view(np.int64)


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """(bits, groups, rows): the bytes of every plane of the two's complement."""
    rows, dims = numbers.shape
    low, high = (int(f(numbers)) if numbers.size else 0 for f in (np.min, np.max))
    bits = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    filled = np.zeros((rows, -(-dims // GROUP) * GROUP), np.int64)
    filled[:, :dims] = numbers
    planes = [np.packbits((filled >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes).transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of each eight components."""
    count, dims = anchors.shape
    filled = np.zeros((count, -(-dims // GROUP) * GROUP), np.int64)
    filled[:, :dims] = anchors
    parts = filled.reshape(count, -1, GROUP).transpose(1, 2, 0)
    sums = np.zeros((len(parts), 1 << GROUP, count), np.int64)
    for i in range(GROUP):
        sums[:, 1 << i:2 << i] = sums[:, :1 << i] + parts[:, i, None]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products by lookup, shift and add."""
    bits, groups, rows = planes.shape
    # Narrow tables are faster; a sum over all groups must fit as well.
    limit = (2 ** 31 - 1) // max(groups, 1)
    small = sums.max(initial=0) <= limit and sums.min(initial=0) >= -limit
    tables = sums.astype(np.int32) if small else sums
    total = np.zeros((rows, sums.shape[2]), np.int64)
    share = np.empty((rows, sums.shape[2]), tables.dtype)
    looked = np.empty_like(share)
    for b in range(bits):
        share[:] = 0
        for g in range(min(groups, len(tables))):
            np.take(tables[g], planes[b, g], axis=0, out=looked, mode="clip")
            share += looked
        shifted = share.astype(np.int64) << b
        total = total - shifted if b == bits - 1 else total + shifted
    return total


def _vectors(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column]


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows of a task in blocks, with a number that no other block has."""
    made, held = 0, None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        while len(held) >= size:
            yield (TaskContext.get().partitionId() << 32) + made, held.iloc[:size]
            made, held = made + 1, held.iloc[size:]
    if held is not None and len(held):
        yield (TaskContext.get().partitionId() << 32) + made, held


def _packed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for number, rows in _blocks(batches, ROWS):
        rows = rows.sort_values("vec_id", kind="stable")  # ties by place are ties by id
        vectors = _vectors(rows["embedding"])
        planes = bit_planes(whole_numbers(vectors, max(map(len, vectors))))
        yield pd.DataFrame([(number, rows["vec_id"].to_numpy(np.int64).tobytes(),
                             rows["label"].to_numpy(np.int64).tobytes(), planes.tobytes(),
                             len(planes), planes.shape[1])], columns=[c.split()[0] for c in BLOCK.split(", ")])


def _packed_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for number, rows in _blocks(batches, ANCHORS):
        vectors = _vectors(rows["embedding"])
        dims = max(map(len, vectors))
        yield pd.DataFrame([(number * ANCHORS, rows["vec_id"].to_numpy(np.int64).tobytes(),
                             rows["label"].to_numpy(np.int64).tobytes(), whole_numbers(vectors, dims).tobytes(),
                             dims)], columns=[c.split()[0] for c in ANCHOR_BLOCK.split(", ")])


class _Best:
    """The `count` best partners of each of an anchor block's slots: (score down, id up)."""

    def __init__(self, slots: int, count: int):
        self.count, self.slots = count, slots
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def least(self) -> np.ndarray:
        """The score a new partner must reach, where a slot is full."""
        out = np.full(self.slots, np.iinfo(np.int64).min)
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.slots) >= self.count)
        if len(full):
            ends = np.searchsorted(self.slot, full, "right") - 1
            out[full] = self.score[ends]
        return out

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in (
            (self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.count
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def _chosen(matrix: np.ndarray, allowed: np.ndarray, least: np.ndarray, count: int):
    """(row, column) of allowed cells that can be among the `count` best of their column."""
    allowed = allowed & (matrix >= least)
    if len(matrix) > count:
        floor = np.iinfo(np.int64).min
        kth = np.partition(np.where(allowed, matrix, floor), -count, axis=0)[-count]
        allowed &= matrix >= kth
    return np.nonzero(allowed)


def _bounds(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores n with 50 p <= 100 n <= 95 p, without leaving 64 bits."""
    return -(-positive // 2), positive + (-positive // 20)


def _read(row, field: str, kind) -> np.ndarray:
    return np.frombuffer(getattr(row, field), kind)


def _row_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _read(row, "ids", np.int64)
    return ids, _read(row, "labels", np.int64), _read(row, "planes", np.uint8).reshape(row.bits, row.groups, len(ids))


def _searched(same: bool, count: int):
    """Run row blocks past anchor blocks; give the best of every anchor (`same` label) or of its positives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, _Best]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, labels, planes = _row_block(row)
                anchor_ids, anchor_labels = _read(row, "a_ids", np.int64), _read(row, "a_labels", np.int64)
                numbers = _read(row, "a_parts", np.int64).reshape(len(anchor_ids), row.a_dims)
                bounds = None if same else np.frombuffer(row.bounds, np.int64).reshape(len(anchor_ids), -1, 2)
                width = 1 if same else bounds.shape[1]
                if row.a_block not in best:
                    best[row.a_block] = anchor_ids, _Best(len(anchor_ids) * width, count)
                _search(planes, ids, labels, numbers, anchor_ids, anchor_labels, bounds,
                        best[row.a_block][1], width, count)
        for block, (anchor_ids, found) in best.items():
            at, part = np.divmod(found.slot, found.slots // len(anchor_ids))
            yield pd.DataFrame({"anchor": block + at, "anchor_id": anchor_ids[at], "part": part.astype(np.int32),
                                "score": found.score, "id": found.id})
    return run


def _search(planes, ids, labels, numbers, anchor_ids, anchor_labels, bounds, best: _Best, width: int,
            count: int) -> None:
    least = best.least().reshape(-1, width)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for label in np.unique(anchor_labels):
        mine = np.flatnonzero(anchor_labels == label)
        rows = np.flatnonzero((labels == label) if bounds is None else (labels != label))
        if not len(rows):
            continue
        here = np.ascontiguousarray(planes[:, :, rows])
        for low in range(0, len(mine), AT_ONCE):
            part = mine[low:low + AT_ONCE]
            matrix = scores(here, subset_sums(numbers[part]))
            others = ids[rows][:, None] != anchor_ids[part][None, :]
            for j in range(width):
                allowed = others
                if bounds is not None:
                    bottom, top = bounds[part, j, 0], bounds[part, j, 1]
                    allowed = others & (matrix >= bottom) & (matrix <= top)
                if not allowed.any():
                    continue
                at, column = _chosen(matrix, allowed, least[part, j], count)
                hits.append((part[column] * width + j, matrix[at, column], ids[rows[at]]))
    if hits:
        best.add(*(np.concatenate(x) for x in zip(*hits)))


def _past(blocks: DataFrame, anchors: DataFrame, columns: list[str], same: bool, count: int) -> DataFrame:
    """Every row block past every anchor block, in rounds of a bounded broadcast."""
    size = F.length("parts") + F.length("ids") + F.length("labels") + (
        F.lit(0) if same else F.length("bounds"))
    total, most = anchors.agg(F.sum(size), F.max(size)).first()
    rounds = 1 + (total or 0) // ROUND_BYTES
    while True:  # until the measured size of every round is bounded
        placed = anchors.withColumn("_round", F.pmod(F.xxhash64("block"), F.lit(rounds)))
        largest = placed.groupBy("_round").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= ROUND_BYTES + (most or 0):
            break
        rounds += 1 + rounds // 4
    renamed = placed.select("_round", *[F.col(c).alias(c if c == "bounds" else f"a_{c}") for c in columns])
    found = []
    for number in range(rounds):
        mine = F.broadcast(renamed.where(F.col("_round") == number).drop("_round").withColumn("_all", F.lit(0)))
        pairs = blocks.withColumn("_all", F.lit(0)).join(mine, "_all").drop("_all")
        found.append(pairs.mapInPandas(_searched(same, count), FOUND))
    return reduce(DataFrame.unionByName, found)


def _top(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= count)


def _with_bounds(batches: Iterator[pd.DataFrame], count: int) -> Iterator[pd.DataFrame]:
    """Anchor blocks with the bounds of their positives; slots without one admit no score."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            slots = len(row.ids) // 8
            bounds = np.tile(np.array([1, 0], np.int64), (slots, count, 1))
            for p in row.positives if row.positives is not None else []:
                low, high = _bounds(np.array([p["score"]], np.int64))
                bounds[p["anchor"] - row.block, p["rank"] - 1] = low[0], high[0]
            out.append(bounds.tobytes())
        yield batch.drop(columns="positives").assign(bounds=out)


def usable(embeddings: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    whole = embeddings.select("vec_id", label.cast("long").alias("label"),
                              F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return whole.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                       & F.col("embedding").isNotNull() & ~bad)


def mine(embeddings: DataFrame, label: Column | None = None, every: int = 50, positives: int = 5,
         negatives: int = 3) -> DataFrame:
    """The first `negatives` rows of another label within half and 95 % of each positive's score."""
    rows = usable(embeddings, F.col("label") if label is None else label)
    blocks = store(rows.mapInPandas(_packed_rows, BLOCK), "vectors")
    anchors = store(rows.where(F.col("vec_id") % every == 0).mapInPandas(_packed_anchors, ANCHOR_BLOCK), "anchors")
    spread = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    columns = ["block", "ids", "labels", "parts", "dims"]
    near = store(_top(_past(spread, anchors, columns, True, positives), ["anchor"], positives), "positives")
    width = near.withColumn("block", F.col("anchor") - F.pmod("anchor", F.lit(ANCHORS)))
    per_block = width.groupBy("block").agg(  # at most ANCHORS * positives
        F.collect_list(F.struct("anchor", "rank", "score")).alias("positives"))
    bounded = store(anchors.join(per_block, "block", "left").mapInPandas(
        lambda batches: _with_bounds(batches, positives), ANCHOR_BLOCK + ", bounds binary"), "bounds")
    far = _past(spread, bounded, [*columns, "bounds"], False, negatives)
    best = _top(far, ["anchor", "part"], negatives)
    pairs = near.select("anchor", (F.col("rank") - 1).alias("part"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return best.join(pairs, ["anchor", "part"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
