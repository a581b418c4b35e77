"""Mixing sources to target weights by fitting subset sums to word budgets.

Sizes are word counts. The targets share `share` of all words by weight and stop at `most`
times their source's words; what is cut is shared again by weight. A source takes all its
documents as often as fits wholly; the rest of its budget is a subset sum over document
counts by exact size: the same share of every size first, long documents next, and
bounded-knapsack dynamic programming on what remains, to the sum nearest to the budget from
either side. The share and the long documents stay fixed there, so the fit is the best for what
remains, not always for all; if it is not exact, one document longer than what remains is also
tried with the others fitted anew. Which documents of one size are
taken is a seeded hash order.

Only counts by (source, size) reach the fitting, one source a group. Nothing grows with a
hot source but these counts. Null texts have size 0; null sources are one source, the
last. Rows with one id are taken together. Sources without words have target 0. An empty
table gives an empty result. Other columns of the input are not read unless kept.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.cells import col
from quiltframe.operators.ordered import dense_position
from quiltframe.operators.scratch import store

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
EXACT_WORDS = 1 << 15
BUCKET_BITS = 8
BROADCAST_PLANS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fit_nearest(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size come near to the budget, from below or above."""
    def error(taken):
        return abs(budget - sum(s * t for s, t in zip(sizes, taken)))

    best = fit_counts(sizes, counts, budget, above=True)
    if budget <= 0 or not error(best):
        return best
    low = fit_counts(sizes, counts, budget)
    left = error(low)
    longer = [i for i, s in enumerate(sizes) if s > left and counts[i] > low[i]]
    tried = [best, low]
    if longer:
        # One document longer than what remains, and the others for the rest of the budget.
        first = min(longer, key=lambda i: sizes[i])
        fewer = [c - (i == first) for i, c in enumerate(counts)]
        rest = fit_counts(sizes, fewer, budget - sizes[first], above=True)
        tried.append([t + (i == first) for i, t in enumerate(rest)])
    return min(tried, key=error)


def fit_counts(sizes: list[int], counts: list[int], budget: int, above: bool = False) -> list[int]:
    """How many documents of each size come nearest to the budget from below, or from either side."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget <= 0 or total == 0:
        return [0] * len(sizes)
    budget = min(budget, total)
    taken = [c * budget // total if s else 0 for s, c in zip(sizes, counts)]
    left = budget - sum(s * t for s, t in zip(sizes, taken))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:  # long documents, leaving EXACT_WORDS to be fitted exactly
        spare = left if sizes[i] > EXACT_WORDS else left - EXACT_WORDS
        if sizes[i] and spare > 0:
            more = min(counts[i] - taken[i], spare // sizes[i])
            taken[i] += more
            left -= more * sizes[i]
    # Reachable sums, as bits; every step is one bundle of equal sizes. Above 2 * left none is nearest.
    over = above and left <= 4 * EXACT_WORDS
    left = min(left, 4 * EXACT_WORDS)
    most = 2 * left if over else left
    mask, reach, steps = (1 << (most + 1)) - 1, 1, []
    for i in order:
        spare = min(counts[i] - taken[i], most // sizes[i]) if sizes[i] else 0
        bundle = 1
        while spare and not reach >> left & 1:
            bundle = min(bundle, spare)
            steps.append((i, bundle, reach))
            reach |= reach << (bundle * sizes[i]) & mask
            spare -= bundle
            bundle *= 2
    goal = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    higher = reach >> (left + 1)
    if higher:
        next_ = left + (higher & -higher).bit_length()
        goal = next_ if next_ - left < left - goal else goal
    for i, bundle, before in reversed(steps):
        if not before >> goal & 1:
            taken[i] += bundle
            goal -= bundle * sizes[i]
    return taken


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    placed = store(dense_position(sources.withColumn("none", F.col("source").isNull()),
                                  ["none", "source"]))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("position") % len(weights) + 1).cast("int"))
    placed = placed.select("source", "source_size", weight.alias("weight"),
                           (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    level = 0.0
    while True:
        # The words per unit of weight, given which sources stop at their cap.
        over = F.col("weight") * F.lit(level) >= F.col("cap")
        full, free, words = placed.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum("source_size"), F.lit(0))).first()
        new = (share * words - full) / free if free else level
        if not new > level:
            break
        level = new
    return placed.select("source", "source_size", F.least(
        F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def plan(sized: DataFrame, seed: int = 7, **options) -> DataFrame:
    """(source, size, source_size, target, base, last): documents of a (source, size) are taken `base`
    times, those up to `last` in seeded order once more. `sized` has id, size, source, draw."""
    counts = store(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = targets(counts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size")), **options)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        base = int(target // size) if size else 0
        group = group.sort_values("size")
        more = fit_nearest([int(x) for x in group["size"]], [int(x) for x in group["n"]],
                           round(target - base * size))
        return group.assign(base=base, more=more)

    named = sources.withColumnRenamed("source", "named")
    joined = counts.join(_small(named), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    plans = store(joined.groupBy("source").applyInPandas(
        fit, "source string, size bigint, n bigint, source_size bigint, target double, base bigint, more bigint"))
    # The `more`-th draw of a (source, size): its bucket by counts, then its rank in the bucket.
    part = plans.where("more > 0 AND more < n").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "more")
    bucket = F.shiftright("draw", 63 - BUCKET_BITS)
    rows = sized.join(_small(part), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))) \
        .select("s", "z", "more", "draw", "id", bucket.alias("bucket"))
    filled = rows.groupBy("s", "z", "more", "bucket").agg(F.count(F.lit(1)).alias("held"))
    running = F.sum("held").over(Window.partitionBy("s", "z").orderBy("bucket"))
    edge = filled.withColumn("upto", running).where("upto >= more AND upto - held < more").select(
        F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("bucket").alias("b2"),
        (F.col("more") - F.col("upto") + F.col("held")).alias("wanted"))
    near = rows.join(_small(edge), F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2"))
                     & (F.col("bucket") == F.col("b2")))
    rank = F.row_number().over(Window.partitionBy("s2", "z2").orderBy("draw", F.col("id").asc_nulls_first()))
    last = near.withColumn("rank", rank).where("rank = wanted").select(
        F.col("s2").alias("s"), F.col("z2").alias("z"),
        F.struct("draw", F.coalesce("id", F.lit(-(1 << 63))).alias("id")).alias("last"))
    every = F.struct(F.lit((1 << 63) - 1).alias("draw"), F.lit((1 << 63) - 1).alias("id"))
    return store(plans.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
                 .select("source", "size", "source_size", "target", "base",
                         F.when((F.col("more") > 0) & (F.col("more") == F.col("n")), every)
                         .otherwise(F.col("last")).alias("last")))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a table of at most BROADCAST_PLANS rows; a larger one is joined by shuffle."""
    table = store(table)
    return F.broadcast(table) if table.count() <= BROADCAST_PLANS else table


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        seed: int = 7, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(id, size, source_size, target, taken) and the columns of `keep`, for every document."""
    ident = col(id).cast("bigint")
    rows = docs.select(
        ident.alias("id"), word_count(col(text)).alias("size"), col(source).cast("string").alias("source"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident), 1).alias("draw"),
        *([F.struct(*[col(k) for k in keep]).alias("kept")] if keep else []))
    # Sizes are counted once; the light table serves all passes of the plan.
    sized = store(rows.select("id", "size", "source", "draw"))
    plans = plan(sized, seed, **options).select(
        F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "base", "last")
    joined = (rows if keep else sized).join(
        _small(plans), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    mine = F.struct("draw", F.coalesce("id", F.lit(-(1 << 63))).alias("id"))
    once = F.coalesce((mine <= F.col("last")).cast("bigint"), F.lit(0))
    return joined.select(
        F.col("id").alias(id) if id not in keep else F.col("id"), "size", "source_size", "target",
        ((F.col("base") + once) * F.col("size")).alias("taken"), *(["kept"] if keep else []))
