"""Secret scan: a trigram inverted index picks the documents on which a rule's regex runs.

From every rule a Boolean trigram query is derived: alternatives, each a set of
trigrams that a matching text must hold, letters lowered. Posting rows (trigram,
document) are made for the trigrams of the queries; a document in the posting lists of
all trigrams of one alternative is a candidate, and only there the regex runs. A rule
without mandatory trigrams runs on every text. The regex decides alone what is found;
the index can only save work.

Null texts are empty. Texts are whole. Repeated rows and null ids are scanned like any
other; rows with one id share their candidate marks, which never changes a result.
Other columns of the input are not read.
"""

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.cells import col

MOST_ALTERNATIVES = 64
MOST_CLASS = 4


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")),
                     _either_case("api") + "_?" + _either_case("key")])
RULES = (
    Rule("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),
)


def _strings(node) -> set[str] | None:
    """All lowered texts a parsed piece can match, None if they are many."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        chars = {chr(v).lower() for _, v in value}
        return chars if len(chars) <= MOST_CLASS else None
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def _segments(nodes) -> list[set[str]]:
    """The stretches of a pattern whose texts are known, one after the other."""
    out, now = [], {""}
    for node in nodes:
        more = _strings(node)
        if more is not None and len(now) * len(more) <= MOST_ALTERNATIVES:
            now = {a + b for a in now for b in more}
            continue
        out.append(now)
        now = more or {""}
        if more is None and node[0] is op.SUBPATTERN:
            out.extend(_segments(node[1][-1]))
        elif more is None and node[0] is op.MAX_REPEAT and node[1][0] > 0:
            out.extend(_segments(node[1][2]))
    return [*out, now]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams, one of which every matching text holds whole; None: none known."""
    query = [frozenset()]
    for texts in _segments(_parser.parse(pattern)):
        grams = {frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts}
        product = {a | b for a in query for b in grams}
        if len(product) <= MOST_ALTERNATIVES:
            query = list(product)
    smallest = [a for a in query if not any(b < a for b in query)]
    return None if frozenset() in smallest else sorted(smallest, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, id): the inverted lists of the given trigrams over lowered texts."""
    lowered = docs.select(col(id).alias("id"), F.lower(col(text)).alias("low"))
    held = F.array_compact(F.array(*[
        F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id",
               text: str = "text") -> DataFrame | None:
    """(id, marks): bit r is set where rule r has a complete alternative; None: no rule has a query."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    wanted = [(1 << r, a, t, 1 << i, (1 << len(alternative)) - 1)
              for r, query in enumerate(queries) for a, alternative in enumerate(query or ())
              for i, t in enumerate(sorted(alternative))]
    if not wanted:
        return None
    # A few rows per rule.
    query_table = F.broadcast(docs.sparkSession.createDataFrame(
        wanted, "rule bigint, alternative int, trigram string, bit bigint, full bigint"))
    lists = postings(docs, sorted({w[2] for w in wanted}), id, text)
    met = lists.join(query_table, "trigram").groupBy("id", "rule", "alternative", "full").agg(
        F.bit_or("bit").alias("bits")).where("bits = full")
    return met.groupBy("id").agg(F.bit_or("rule").alias("marks"))


def _spans(pieces: Column, found: Column, groups: Column, order: int, least: int) -> Column:
    """(start, order, end) of the matches, from the texts between and in them."""
    end = F.lit(0).cast("bigint")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(state, item):
        start = state["at"] + F.length(item["piece"])
        stop = start + F.length(item["found"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), stop.alias("end")))
        kept = F.when(F.length(item["held"]) >= least, F.concat(state["spans"], span)).otherwise(
            state["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    items = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found"),
                         groups.alias("held"))
    items = items.cast("array<struct<piece:string,found:string,held:string>>")
    return F.when(F.size(found) > 0, F.aggregate(
        items, F.struct(end.alias("at"), empty.alias("spans")), step)["spans"]).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id",
         text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, spans) and the columns named in `keep`, for every row.

    spans: array of (start, kind, end) by start, then kind; code points, end exclusive;
    kind counts the rules. Matches of one rule are leftmost and do not overlap.
    """
    rows = docs.select(col(id).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"),
                       F.struct(*[col(k) for k in keep]).alias("kept") if keep
                       else F.lit(None).cast("int").alias("kept"))
    marked = candidates(docs, rules, id, text)
    if marked is not None:
        marked = marked.withColumnRenamed("id", "marked_id")
        rows = rows.join(marked, F.col("id").eqNullSafe(F.col("marked_id")), "left").drop("marked_id")
    else:
        rows = rows.withColumn("marks", F.lit(0).cast("bigint"))
    parts = {}
    for r, rule in enumerate(rules):
        runs = F.lit(True) if trigram_query(rule.pattern) is None else \
            F.coalesce(F.col("marks").bitwiseAND(F.lit(1 << r)) != 0, F.lit(False))
        # split() and the extractions find the same matches; without one nothing is cut.
        here = runs & F.col("text").rlike(rule.pattern)
        parts |= {
            f"found_{r}": F.when(here, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))),
            f"piece_{r}": F.when(here, F.split("text", rule.pattern, -1))}
        if rule.group:
            parts[f"group_{r}"] = F.when(here, F.regexp_extract_all(
                "text", F.lit(rule.pattern), F.lit(rule.group)))
    cut = rows.select("id", "text", "kept", *[v.alias(k) for k, v in parts.items()])
    spans = [_spans(F.col(f"piece_{r}"), F.col(f"found_{r}"),
                    F.col(f"group_{r}" if rule.group else f"found_{r}"), r, rule.least)
             for r, rule in enumerate(rules)]
    return cut.select("id", "text", "kept", F.array_sort(F.concat(*spans)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mask."""
    def step(state, s):
        opens = s["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(opens, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"))

    return F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step,
        lambda state: F.concat(state["out"], F.substring(
            text, (state["at"] + 1).cast("int"), F.length(text))))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def secrets_found(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Per document the number of spans of each kind, the spans as text, and their SHA-256."""
    found = scan(docs, rules, id, text).withColumn("listed", span_text(F.col("spans"), rules))
    return found.select(
        F.col("id").alias(id),
        *[_count(r).alias(f"n_{rule.kind}") for r, rule in enumerate(rules)],
        F.sha2("listed", 256).alias("base_sha256"), F.col("listed").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """The documents with their secrets masked; `n_chars` counts the new text, if there is such a column.

    Rows without a secret stay as they are, null texts too.
    """
    found = scan(docs, rules, keep=tuple(docs.columns)).select(
        "kept", F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"), mask)).alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return found.select(*[
        F.coalesce(changed[n], F.col("kept")[n]).alias(n) if n in changed else F.col("kept")[n].alias(n)
        for n in docs.columns])


def duck_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digest for DuckDB."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    lists = ", ".join(
        f"regexp_extract_all(t, {quoted(r.pattern)}, 0) AS f{i}, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g{i}, "
        f"list_transform(string_split_regex(t, {quoted(r.pattern)}), lambda x: length(x)) AS p{i}"
        for i, r in enumerate(rules))
    ends = ", ".join(
        f"list_transform(range(1, len(f{i}) + 1), lambda j: struct_pack("
        f"s := list_sum(p{i}[1:j]) + coalesce(list_sum(list_transform(f{i}[1:j-1], lambda x: length(x))), 0), "
        f"k := {i}, n := length(f{i}[j]), g := length(g{i}[j]))) AS a{i}"
        for i in range(len(rules)))
    kept = ", ".join(f"list_filter(a{i}, lambda z: z.g >= {r.least}) AS b{i}" for i, r in enumerate(rules))
    names = "[" + ", ".join(quoted(r.kind) for r in rules) + "]"
    joined = " || ".join(f"b{i}" for i in range(len(rules)))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {lists} FROM texts),
placed AS (SELECT doc_id, {ends} FROM found),
kept AS (SELECT doc_id, {kept} FROM placed),
listed AS (SELECT *, coalesce(list_aggregate(list_transform(list_sort({joined}), lambda z:
  {names}[z.k + 1] || ':' || z.s::BIGINT || ':' || (z.s + z.n)::BIGINT), 'string_agg', ','), '') AS spans FROM kept)
SELECT doc_id, {", ".join(f"len(b{i})::BIGINT AS n_{r.kind}" for i, r in enumerate(rules))},
  sha256(spans) AS base_sha256, spans FROM listed"""
