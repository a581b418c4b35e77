"""Line-first cleaning: rules judge lines, failing lines go, and a text that loses too much is rejected.

A line fails if it
* ends no sentence, in it or at its end (closing quotes and brackets may follow the mark), or more
  than half of its words end in ! or ?            -- punctuation
* holds two separators or more, over one for five words, or over a tenth symbols   -- navigation
* holds a phrase of notices, menus or forms                                        -- boilerplate
Lines without a word are neither kept nor lost. A text is rejected if over half of its words stand
in failing lines, or by the base rules (too few words, too many repeated word triples).

Only built-in expressions; every row is judged by itself, so nothing is shuffled. Equal word triples
are found by sorting a text's hashes (64 bits less those its places need), never by comparing all with
all. What a whole text lacks (symbols, phrases, marks) is not looked for in its lines.

Cases. NULL and empty texts have no words and are rejected (under 50 words). Repeated rows and rows of
one doc_id are judged each; an empty table gives no rows. Columns to keep travel in a struct, so no name
can clash. One text of any length is one row of work.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
SYMBOLS, SEPARATORS = "#*$%&|<>", "|»›•·→"
SENTENCE_END = r"""[.!?…。！？][\"'”’»)\]]*(""" + GAP + "|$)"
BOILERPLATE = [
    "all rights reserved", "cookie", "copyright", "licensed under", "terms of use", "terms of service", "privacy policy",
    "javascript", "lorem ipsum", "subscribe", "sign in", "sign up", "log in", "read more", "click here", "skip to content",
]
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50


def _absent(text: Column, characters: str) -> Column:
    """How many characters of the set a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def failing(line: Column, has: dict[str, Column]) -> Column:
    """Whether a line fails a rule; `has` tells what its text holds at all."""
    separators = _absent(line, SEPARATORS)
    return (~line.rlike(SENTENCE_END)
            | (has["marks"] & (2 * F.regexp_count(line, F.lit(f"[!?]({GAP}|$)")) > _words(line)))
            | (has["separators"] & (separators >= 2) & (5 * separators > _words(line)))
            | (has["symbols"] & (10 * _absent(line, SYMBOLS) > F.length(line)))
            | (has["phrases"] & F.lower(line).rlike("|".join(BOILERPLATE))))


def _holds(text: Column, lowered: Column) -> dict[str, Column]:
    """What the rules ask for, looked for in a whole text."""
    phrases = [F.contains(lowered, F.lit(p)) for p in BOILERPLATE]
    return {"marks": F.contains(text, F.lit("!")) | F.contains(text, F.lit("?")),
            "separators": _absent(text, SEPARATORS) >= 2, "symbols": _absent(text, SYMBOLS) > 0,
            "phrases": reduce(Column.__or__, phrases)}


def _repeated_places(rows: DataFrame) -> DataFrame:
    """Add `places`: where the word triples begin that occur twice or more, in order."""
    bits = F.length(F.bin(F.size("words").cast("long")))
    rows = rows.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "bits": bits})
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    triples = F.transform("hashes", lambda h, i: F.call_function(
        "shiftleft", high(F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))), F.col("bits")
    ).bitwiseOR(i.cast("long")))
    whole = F.slice(triples, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    rows = rows.withColumn("triples", F.sort_array(whole))
    twice = F.filter("triples", lambda t, i: (high(t) == high(F.get("triples", i - 1))).eqNullSafe(True)
                     | (high(t) == high(F.get("triples", i + 1))).eqNullSafe(True))
    below = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    return rows.withColumn("places", F.sort_array(F.transform(twice, lambda t: t.bitwiseAND(below))))


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """kept_columns, the counts of every text, the lines that stay, and the verdict."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_columns"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({
        "words": F.filter(F.split("text", f"{GAP}+"), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)),
        "lowered": F.lower("text")})
    holds = _holds(F.col("text"), F.col("lowered"))
    rows = _repeated_places(rows.withColumns({f"has_{k}": v for k, v in holds.items()}).drop("lowered"))
    has = {k: F.col(f"has_{k}") for k in holds}
    rows = rows.withColumn("failing", F.filter("lines", lambda line: failing(line, has)))
    # A place covers three words, or those up to the next place.
    three, zero = F.lit(3).cast("long"), F.lit(0).cast("long")
    fresh = F.transform("places", lambda at, i: F.least(three, F.coalesce(F.get("places", i + 1) - at, three)))
    return rows.select(
        "kept_columns",
        F.size("words").cast("long").alias("n_words"),
        _absent(F.col("text"), " \t\n\x0b\x0c\r").alias("_gaps"),
        F.length("text").cast("long").alias("_chars"),
        _absent(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(fresh, zero, lambda total, n: total + n).alias("n_repeat_words"),
        F.aggregate("failing", zero, lambda total, line: total + _words(line)).alias("n_lost_words"),
        "lines", "failing",
    ).withColumn("word_chars", F.col("_chars") - F.col("_gaps")).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MOST_LOST * F.col("n_words"))
    ).drop("_gaps", "_chars")


def clean(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept_columns, text): the texts that are kept, without their failing lines."""
    # A line's verdict depends on nothing but the line, so equal lines share it.
    rest = F.filter("lines", lambda line: ~F.array_contains("failing", line))
    return judged(docs, keep).where("kept").select("kept_columns", F.array_join(rest, "\n").alias("text"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, whether the base rules fail it, and the verdict."""
    return judged(docs).select(
        "kept_columns.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lost_words", "base_failed", "kept")


def duck_sql() -> str:
    """The same rows by DuckDB."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    end = SENTENCE_END.replace(GAP, gap).replace('\\"', '"')

    def held(x: str, characters: str) -> str:
        return f"(length({x}) - length(translate({x}, {text(characters)}, '')))"

    def found(x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {text(pattern)}))"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, regexp_extract_all(t, {text(word)}) AS w FROM d),
triples AS (SELECT k, unnest(range(1, len(w) - 1)) AS p, unnest([{{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}}
    FOR i IN range(1, len(w) - 1)]) AS x FROM w WHERE len(w) >= 3),
twice AS (SELECT k, p FROM triples QUALIFY count(*) OVER (PARTITION BY k, x) > 1),
repeated AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY k),
lines AS (SELECT k, line, {found('line', word)} AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, {text(word)})),
marks AS (SELECT k, line, n, NOT regexp_matches(line, {text(end)})
      OR 2 * {found('line', f'[!?]({gap}|$)')} > n
      OR ({held('line', SEPARATORS)} >= 2 AND 5 * {held('line', SEPARATORS)} > n)
      OR 10 * {held('line', SYMBOLS)} > length(line)
      OR regexp_matches(lower(line), {text('|'.join(BOILERPLATE))}) AS fails FROM lines),
sums AS (SELECT k, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost
    FROM marks GROUP BY k),
c AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, list_sum([length(x) FOR x IN w.w]) AS chars,
      {held('t', SYMBOLS)} AS symbols, coalesce(dup, 0) AS dup, coalesce(r.n, 0)::BIGINT AS rep, coalesce(lost, 0)::BIGINT AS lost
    FROM d JOIN w USING (k) LEFT JOIN sums USING (k) LEFT JOIN repeated r USING (k))
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  rep AS n_repeat_words, lost AS n_lost_words, (n_words < {LEAST_WORDS} OR 100 * rep > {MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * rep > {MOST_REPEATED} * n_words) AND 100 * lost <= {MOST_LOST} * n_words AS kept
FROM c"""
