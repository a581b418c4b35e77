"""Document fingerprints by Order MinHash.

A text is its words, words of over 16 code points cut into pieces. Its k-mers are numbered
by occurrence, so that repeats count. One hash of (k-mer, number) gives both a bucket and
an order: of each of `buckets` buckets the `tuple` smallest k-mers are kept, put back into
text order and hashed together. Two texts agree in a bucket if they share its smallest
k-mers in the same order, so moved words change the fingerprint although the set of words
is the same. Likeness is the share of agreeing buckets among those that either text fills.

Everything is an expression over one row; a fingerprint costs two sorts of the text's
k-mers. Null texts are empty; empty texts have an empty fingerprint and likeness 1 to each
other, 0 to others. Equal texts have equal fingerprints.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.cells import col

K, BUCKET_BITS, TUPLE = 2, 5, 2
PIECE = "[^\\x20\\x09-\\x0D]{1,16}"
HASH_BITS = 64 - BUCKET_BITS
AT_BITS = 26
DOCS_PER_BLOCK = 2000
MOST_BLOCKS = 10_000


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, k: int = K) -> Column:
    """array<bigint>: per filled bucket its number in the high bits and the hash of its k-mers.

    Arrays to be sorted hold plain numbers, a hash above AT_BITS bits of the place in the text.
    """
    low = F.lit((1 << AT_BITS) - 1)

    def packed(hashed, at):
        return F.shiftleft(F.shiftright(hashed, AT_BITS), AT_BITS).bitwiseOR(at)

    def head(value):
        return F.shiftright(value, AT_BITS)

    def bucket(value):
        return F.shiftrightunsigned(value, HASH_BITS)

    def grams(words):
        # The last k - 1 words start no k-mer, but a shorter text is one.
        count = F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1)))
        return F.sort_array(F.transform(F.slice(words, 1, count), lambda w, i: packed(
            F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]), i)))

    def numbered(ordered):
        firsts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1),
                          lambda i: head(F.get(ordered, i)) != F.coalesce(head(F.get(ordered, i - 1)), F.lit(-1 << 62)))

        def runs(starts):
            def run(start, j):
                stop = F.coalesce(F.get(starts, j + 1), F.size(ordered))
                return F.transform(F.slice(ordered, start + 1, stop - start), lambda e, n: packed(
                    F.xxhash64(head(e), n), e.bitwiseAND(low)))
            return F.flatten(F.transform(starts, run))

        return F.sort_array(_let(firsts, runs))

    def signature(ranked):
        def smallest(entry, i):
            return F.coalesce(bucket(F.get(ranked, i - TUPLE)), F.lit(-1)) != bucket(entry)

        def hashed(kept):
            def joined(entry, i):
                other = F.get(kept, i + 1)
                alone = F.coalesce(bucket(other) != bucket(entry), F.lit(True))
                earlier = entry.bitwiseAND(low) <= other.bitwiseAND(low)
                value = F.when(alone, F.xxhash64(head(entry))).when(
                    earlier, F.xxhash64(head(entry), head(other))).otherwise(F.xxhash64(head(other), head(entry)))
                opens = F.coalesce(bucket(F.get(kept, i - 1)), F.lit(-1)) != bucket(entry)
                return F.when(opens, F.shiftleft(bucket(entry), HASH_BITS).bitwiseOR(
                    F.shiftrightunsigned(value, BUCKET_BITS)))
            return F.array_compact(F.transform(kept, joined))

        return _let(F.filter(ranked, smallest), hashed)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    empty = F.array().cast("array<bigint>")
    return F.coalesce(_let(words, lambda w: F.when(F.size(w) > 0, _let(grams(w), lambda g: _let(
        numbered(g), signature)))), empty)


def likeness(a: Column, b: Column) -> Column:
    def filled(x):
        return F.transform(x, lambda v: F.shiftrightunsigned(v, HASH_BITS))

    either = F.size(F.array_union(filled(a), filled(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(value: Column) -> Column:
    return F.array_join(F.transform(value, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def with_next(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Add next_<column> for the named columns: those of the following row in the order, after the last the first.

    Rows are cut into blocks at quantiles of the order column; the first row of a block is
    copied to the block before it. Rows equal in the order column stay in one block, and
    follow each other by all their columns. Nulls come first.
    """
    place = col(order).cast("double")
    count, low = rows.agg(F.count(F.lit(1)), F.min(place)).first()
    blocks = max(1, min(MOST_BLOCKS, count // DOCS_PER_BLOCK))
    cuts = rows.select(F.percentile_approx(place, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] \
        if blocks > 1 and low is not None else []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    block = F.coalesce(F.size(F.filter(cuts, lambda c: c < place)), F.lit(0))
    placed = rows.withColumn("_block", block)
    # One row per block: its first value of the order; nulls are in block 0.
    heads = sorted((r[0], r[1]) for r in placed.groupBy("_block").agg(
        F.count_if(col(order).isNull()).alias("nulls"), F.min(col(order)).alias("first"))
        .select("_block", F.when(F.col("nulls") == 0, F.col("first"))).collect())
    if not heads:
        return placed.select(*rows.columns, *[col(c).alias(f"next_{c}") for c in columns])
    # block -> the block that needs its head, or the last one for the very first row.
    previous = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    before = F.create_map(*[F.lit(x) for pair in previous.items() for x in pair])
    first = F.create_map(*[x for b, v in heads for x in (F.lit(b), F.lit(v).cast(rows.schema[order].dataType))])
    head = col(order).eqNullSafe(first[F.col("_block")])
    spread = placed.select("*", F.explode(F.when(head, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False)))).alias("_copy"))
    spread = spread.withColumn("_at", F.when(F.col("_copy"), before[F.col("_block")]).otherwise(F.col("_block")))
    keys = [col(order).asc_nulls_first(), *[col(c).asc_nulls_first() for c in rows.columns if c != order]]
    window = Window.partitionBy("_at").orderBy("_copy", *keys)
    out = spread.select(*rows.columns, "_copy", *[
        F.lead(F.struct(col(c))).over(window)[c].alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_copy")).drop("_copy")


def edited_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint, its edited text's, and their likeness to it and to the next text.

    Edited: the last quarter of the code points (rounded down) is replaced by as many, or
    all, of the first of the next document by id; the first document follows the last.
    """
    rows = docs.select(col(id).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", fingerprint(F.col("text")))
    paired = with_next(rows, "id", ["text", "mark"])
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - quarter),
                      F.substring(F.col("next_text"), F.lit(1), quarter))
    paired = paired.select("id", size.cast("bigint").alias("n_chars"), "mark", "next_mark", edited.alias("edited"))
    paired = paired.select("*", fingerprint(F.col("edited")).alias("edited_mark"))
    return paired.select(
        F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("mark")).alias("fingerprint"), as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"))
