"""Benchmark decontamination by spaced seeds.

Texts are lower-cased words. A mask selects some positions of a window and ignores the
others, so a window that differs only in ignored positions has the same seed. The seeds of
all document windows meet the seeds of the benchmark; a hit fixes an alignment of a
document and an item. Around it all words are compared: of the item laid on the document
every stretch is an overlap that has `least` words at least, or the whole item if that is
shorter, of which `identity` match, and that lies in no longer such stretch. It may begin
and end with substituted words. Short items, of which few windows hold, have masks of their
own, which leave out every set of words that may be substituted.

Documents are cut into blocks of windows, so a long text is many rows. The seed table is
broadcast if it has at most BROADCAST_SEEDS rows, otherwise joined by shuffle, where Spark
splits seeds that many documents share. Hits collapse to alignments in the task that finds
them. Texts meet their alignments again by document id.

Null and empty texts, items without words and rows with a null item id and text have no
overlaps. Rows with one document id are searched each for itself but are not told apart in
the result. Repeated items count once. Other columns are not read.
"""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.operators.scratch import store

# 1 is compared, 0 ignored. Six compared words rarely meet by chance.
MASKS = ("11101011", "1100110011", "110100100011")
LEAST, IDENTITY = 10, 0.8
UNIT = 1_000_000  # identity is compared with six decimals
BLOCK = 512
BROADCAST_SEEDS = 1_000_000
BROADCAST_DOCS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _seeds(rows: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """The named columns, `at` and `seed` of all windows of the word hashes in column `words`."""
    # The mask is part of the seed, so that seeds of different masks do not meet.
    # Plain expressions between explodes: one compiled loop, the array is never copied.
    places = rows.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))

    def seed(mask: str) -> Column:
        return F.when(F.col("at") + len(mask) <= F.size("words"), F.xxhash64(
            F.lit(mask), *[F.get("words", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]))

    seeds = F.array(*map(seed, masks))
    return places.select(*keep, "at", F.explode(seeds).alias("seed")).where(F.col("seed").isNotNull())


def _items(benchmark: DataFrame, id: str, text: str) -> DataFrame:
    """(item, item_id, words, n): item tells apart different texts of one id."""
    rows = benchmark.select(col(id).alias("item_id"), _words(col(text)).alias("w"))
    rows = rows.where(F.size("w") > 0).select(
        "item_id", F.transform("w", lambda x: F.xxhash64(x)).alias("words"))
    return rows.distinct().select(
        F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n"))


def _covering(width: int, most: int) -> list[str]:
    """Masks of one width: whichever `most` of its words differ, one mask ignores them all."""
    parts = min(width, 2 * most + 1)
    ends = [width * i // parts for i in range(parts + 1)]
    return ["".join("01"[i not in left_out] * (ends[i + 1] - ends[i]) for i in range(parts))
            for left_out in itertools.combinations(range(parts), most)]


def _masks_for(items: DataFrame, masks: tuple[str, ...], least: int, identity: float) -> tuple[str, ...]:
    """The masks, and those that find every overlap of the short items.

    An overlap of an item under `least` words is the whole item. One of a longer item holds a
    window of `least` words with no more substitutions than itself; the item is short if these
    are no more than `least` words may have.
    """
    def allowed(words: int) -> int:
        return int(round(words * (1 - identity), 6))

    lengths = [r.n for r in items.where(F.col("n") <= F.lit(4 * least)).select("n").distinct().collect()]  # few
    short = {min(n, least) for n in lengths if n < least or allowed(n) == allowed(least)}
    return tuple(dict.fromkeys([*masks, *(m for n in sorted(short) for m in _covering(n, allowed(n)))]))


def alignments(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(id, item, shift): where the item's first word would stand in the document."""
    span = max(map(len, masks))
    hashed = docs.select(col(id).alias("id"), F.transform(_words(col(text)), lambda w: F.xxhash64(w)).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK))
    blocks = hashed.where(F.size("words") > 0).select("id", F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.slice("words", s + 1, BLOCK + span - 1).alias("words")))).alias("b"))
    blocks = blocks.select("id", F.col("b.start").alias("start"), F.col("b.words").alias("words"))
    found = _seeds(blocks, masks, "id", "start").select("id", (F.col("start") + F.col("at")).alias("at"), "seed")
    known = _seeds(items, masks, "item").withColumnRenamed("at", "item_at")
    if known.count() <= BROADCAST_SEEDS:
        known = F.broadcast(known)
    return found.join(known, "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def _lows(pairs: Column, cost: int) -> Column:
    """Places whose prefix sum (UNIT a match, -cost a word) is below all before: array of (at, sum), from 0."""
    zero = F.lit(0).cast("bigint")
    first = F.struct(zero.alias("at"), zero.alias("sum"))
    start = F.struct(zero.alias("at"), zero.alias("sum"), zero.alias("low"), F.array(first).alias("lows"))

    def step(s, same):
        at, total = s["at"] + 1, s["sum"] + F.when(same, UNIT - cost).otherwise(-cost)
        here = F.array(F.struct(at.alias("at"), total.alias("sum")))
        return F.struct(at.alias("at"), total.alias("sum"), F.least(s["low"], total).alias("low"),
                        F.when(total < s["low"], F.concat(s["lows"], here)).otherwise(s["lows"]).alias("lows"))

    return F.aggregate(pairs, start, step, lambda s: s["lows"])


def _stretches(pairs: Column, least: Column, identity: float) -> Column:
    """The maximal stretches of an array of booleans with `least` elements, `identity` of them true: (from, to, matched)."""
    cost, size = round(identity * UNIT), F.size(pairs)
    total = F.size(F.filter(pairs, lambda p: p)).cast("bigint") * UNIT - F.lit(cost).cast("bigint") * size
    # A maximal stretch starts at a low of the sums from the left and ends at one of those from the right.
    ends = _lows(F.reverse(pairs), cost)

    def widest(low):
        end = F.filter(ends, lambda e: e["sum"] <= total - low["sum"])[0]
        length = size - end["at"] - low["at"]
        gain = total - low["sum"] - end["sum"]
        return F.struct(low["at"].alias("from"), (size - end["at"]).alias("to"),
                        ((gain + cost * length) / UNIT).cast("bigint").alias("matched"))

    spans = F.filter(F.transform(_lows(pairs, cost), widest), lambda s: s["to"] - s["from"] >= least)
    # Of those with one end the first is the widest; ends never fall.
    return F.filter(F.transform(spans, lambda s, i: F.when(
        (i == 0) | (F.get(spans, i - 1)["to"] < s["to"]), s)), lambda s: s.isNotNull())


def overlaps(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS,
             least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """(id, item_id, start, end, matched): verified overlaps, in words of the document, end exclusive."""
    items = _items(benchmark, item_id, item_text)
    masks = _masks_for(items, masks, least, identity)
    hits = alignments(docs, items, masks, id, text)
    # One row per document with a hit; its alignments are at most its words times the items'.
    per_doc = hits.groupBy("id").agg(F.collect_set(F.struct("item", "shift")).alias("hits")) \
        .withColumnRenamed("id", "hit_id")
    per_doc = store(per_doc)
    if per_doc.select(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0] <= BROADCAST_DOCS:
        per_doc = F.broadcast(per_doc)
    rows = docs.select(col(id).alias("id"), col(text).alias("text")).join(
        per_doc, F.col("id").eqNullSafe(F.col("hit_id"))).select(
        "id", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"), "hits")
    # Only the words under an item leave the document's row.
    laid = rows.select("id", F.size("words").alias("size"), "words", F.explode("hits").alias("hit"))
    item_rows = items.select("item", "item_id", F.col("words").alias("item_words"), "n")
    laid = laid.join(F.broadcast(item_rows) if items.count() <= BROADCAST_DOCS else item_rows,
                     F.col("hit.item") == F.col("item"))
    first = F.greatest(F.col("hit.shift"), F.lit(0))
    skip = first - F.col("hit.shift")
    length = F.least(F.col("size") - first, F.col("n") - skip)
    laid = laid.where(length > 0).select(
        "id", "item_id", "n", first.alias("first"),
        F.zip_with(F.slice("words", first + 1, length), F.slice("item_words", skip + 1, length),
                   lambda a, b: a == b).alias("same"))
    needed = F.least(F.lit(least), F.col("n"))
    laid = laid.where(F.size(F.filter("same", lambda p: p)) >= F.ceil(F.round(identity * needed, 6)))
    found = laid.select("id", "item_id", "first", F.explode(_stretches(F.col("same"), needed, identity)).alias("s"))
    return found.select(
        F.col("id").alias(id), F.col("item_id").alias("item_id"),
        (F.col("first") + F.col("s.from")).cast("bigint").alias("start"),
        (F.col("first") + F.col("s.to")).cast("bigint").alias("end"), F.col("s.matched").alias("matched")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """The documents without an overlap with the benchmark."""
    found = store(overlaps(docs, benchmark, id, **options).select(col(id).alias("_hit_id")).distinct())
    if found.count() <= BROADCAST_DOCS:
        found = F.broadcast(found)
    return docs.join(found, col(id).eqNullSafe(F.col("_hit_id")), "left_anti")
