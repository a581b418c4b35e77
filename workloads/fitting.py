"""Column models and correlations."""

from pyspark.sql import functions as F

from quiltframe.functions.text import model_label
from quiltframe.operators import fit as M
from quiltframe.operators.frequency import value_counts
from workloads.base import query, r, rounded, union_all

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _numeric_sql(c):
    whole = f"bool_and(abs({c} - round_even({c}, 0)) <= 1e-9)"
    named = "true" if any(w in c for w in ("price", "discount", "tax")) else "false"
    return f"""SELECT '{c}' AS "column", count({c}) AS n, {r(f'avg({c})')} AS mean,
        {r(f'stddev_pop({c})')} AS deviation, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
        CASE WHEN NOT {whole} AND {named} THEN 2 ELSE 0 END AS decimals,
        {whole} AND bool_and({c} BETWEEN 100000 AND 999999) AS six_digit,
        {r(f'power(count({c})::DOUBLE, -2e-1)', 6)} AS bandwidth FROM lineitem"""


@query(union_all([_numeric_sql(c) for c in NUMBERS]))
def numeric_models(t):
    df = t.lineitem
    row = df.agg(*[M.numeric_aggregate(F.col(c).cast("double")).alias(c) for c in NUMBERS]).first()
    models = [(c, M.numeric_model(c, row[c])) for c in NUMBERS]
    out = t.spark.createDataFrame(
        [(c, m.n, m.mean, m.deviation, m.low, m.high, m.decimals, m.six_digit, m.bandwidth)
         for c, m in models],
        "column string, n bigint, mean double, deviation double, low double, high double, "
        "decimals int, six_digit boolean, bandwidth double")
    return rounded(out.drop("bandwidth")).join(rounded(out.select("column", "bandwidth"), 6), "column")


TIMES = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]


@query(union_all([f"""SELECT '{c}' AS "column", count({c}) AS n, min({c}) AS first, max({c}) AS last,
       bool_and({c} = date_trunc('day', {c})) AS date_only, count(DISTINCT {c}) AS "distinct",
       date_diff('day', min({c})::DATE, max({c})::DATE)::BIGINT AS span_days,
       floor(epoch(max({c})) - epoch(min({c})))::BIGINT AS span_seconds FROM {t}""" for t, c in TIMES]))
def time_models(t):
    rows = []
    for table, c in TIMES:
        df = getattr(t, table)
        m = M.time_model(df.agg(M.time_aggregate(M.time_of(df, c)).alias("m")).first()["m"],
                         M.distinct_times(df, [c])[c])
        rows.append((c, m.n, m.first, m.last, m.date_only, m.distinct, m.span_days, m.span_seconds))
    return t.spark.createDataFrame(
        rows, "column string, n bigint, first timestamp_ntz, last timestamp_ntz, date_only boolean, "
              "distinct bigint, span_days bigint, span_seconds bigint")


TAIL = r"regexp_extract({c}, '(\d+)$', 1)"


@query(r"""SELECT 'c_name' AS "column", 'Customer#' AS prefix, max(length(regexp_extract(c_name, '(\d+)$', 1)))::INTEGER
       AS width, max(regexp_extract(c_name, '(\d+)$', 1)::BIGINT) + 1 AS start, false AS uuid FROM customer
       UNION ALL SELECT 's_code', 'SUP-', max(length(s_suppkey::VARCHAR))::INTEGER, max(s_suppkey) + 1, false FROM supplier
       UNION ALL SELECT 'o_code', 'OR', max(length(o_orderkey::VARCHAR))::INTEGER, max(o_orderkey) + 1, false FROM orders
       UNION ALL SELECT 'p_name', '', 5, 1::BIGINT, true FROM (SELECT count(*) FROM part)""")
def id_models(t):
    """One prefix with #, a plain one, two prefixes sharing their start, and no numbering."""
    tables = [
        (t.customer.select("c_name"), "c_name"),
        (t.supplier.select(F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("s_code")), "s_code"),
        (t.orders.select(F.concat(F.when(F.col("o_totalprice") > 2e5, "ORD-").otherwise("ORX-"),
                                  F.col("o_orderkey").cast("string")).alias("o_code")), "o_code"),
        (t.part.select("p_name"), "p_name"),
    ]
    rows = []
    for df, c in tables:
        m = M.id_model(df.agg(M.id_aggregate(F.col(c)).alias("m")).first()["m"], M._top_prefix(df, c))
        rows.append((c, m.prefix, m.width, m.start, m.uuid))
    return t.spark.createDataFrame(
        rows, "column string, prefix string, width int, start bigint, uuid boolean")


LABELS = ["o_orderstatus", "o_orderpriority", "dear"]


def _label_sql(c):
    value = "CASE WHEN o_totalprice > 2e5 THEN 'TRUE' ELSE 'FALSE' END" if c == "dear" else c
    return f"""SELECT '{c}' AS "column", {value} AS value, {r('count(*)::DOUBLE / (SELECT count(*) FROM orders)')}
        AS p, (SELECT min(length({value})) FROM orders)::INTEGER AS shortest FROM orders GROUP BY {value}"""


@query(union_all([_label_sql(c) for c in LABELS]))
def categorical_models(t):
    """Label shares and the shortest label, a boolean column included."""
    df = t.orders.withColumn("dear", F.col("o_totalprice") > 2e5)
    freq = value_counts(df, LABELS, label=model_label)
    totals = freq.groupBy("column").agg(
        F.sum("n").alias("total"), F.min(F.length("value")).alias("shortest"))
    return rounded(freq.join(F.broadcast(totals), "column").select(  # one row per column
        "column", "value", (F.col("n") / F.col("total")).alias("p"), "shortest"))


def _gap(c):
    return "nullif(l_tax, 0e0)" if c == "l_tax" else c


@query(union_all([f"SELECT '{a}' AS a, '{b}' AS b, "
                  + (r(f"corr({_gap(a)}, {_gap(b)})", 6) if a != b else "1e0") + " AS r FROM "
                  + ("lineitem" if a != b else "(SELECT 1)") for a in NUMBERS for b in NUMBERS]))
def correlations(t):
    df = t.lineitem.select(*NUMBERS).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return rounded(M.correlations(df, NUMBERS), 6)


# Thirty-two columns from three of lineitem: shifted powers, with gaps of their own.
WIDE = [(f"w{i}", ("l_quantity", "l_extendedprice", "l_discount")[i % 3], i + 2) for i in range(32)]
WIDE_SQL = "(SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + l_linenumber) % {gap} <> 1 THEN sqrt({c} + {gap}e0) + {c} * (l_linenumber % {gap}) END AS {n}"
    for n, c, gap in WIDE) + " FROM lineitem)"


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS r FROM {WIDE_SQL}" if a != b else
    f"SELECT '{a}' AS a, '{b}' AS b, 1e0 AS r" for a, _, _ in WIDE[::5] for b, _, _ in WIDE))
def wide_correlations(t):
    """All pairs of thirty-two columns in one scan; those of every fifth column are shown."""
    df = t.lineitem.select(*[F.when(
        (F.col("l_orderkey") + F.col("l_linenumber")) % gap != 1,
        F.sqrt(F.col(c) + gap) + F.col(c) * (F.col("l_linenumber") % gap)).alias(n) for n, c, gap in WIDE])
    return rounded(M.correlations(df, df.columns).where(F.col("a").isin([n for n, _, _ in WIDE[::5]])), 6)
