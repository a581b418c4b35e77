"""Exact, conflicting and near duplicates."""

from pyspark.sql import functions as F

from quiltframe.functions.similarity import matching_ratio
from quiltframe.functions.text import fingerprint
from quiltframe.operators import dedup as D
from quiltframe.operators import near as N
from workloads.base import query, r, rounded
from workloads.neartext import first_sql, kept_sql, near_sql, squeezed

KEYED = ["o_custkey", "o_orderstatus", "o_orderpriority"]
KEYS = ", ".join(KEYED)


def orders(t):
    return t.orders.select(*KEYED)


@query(f"SELECT DISTINCT {KEYS} FROM orders")
def distinct_rows(t):
    return D.drop_exact(orders(t))


@query("""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def last_row_per_key(t):
    return D.drop_exact(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY status
       ORDER BY o_orderkey DESC) AS rn FROM (SELECT o_orderkey, o_custkey,
       nullif(o_orderstatus, 'F') AS status FROM orders)) WHERE rn = 1""")
def last_row_per_key_with_nulls(t):
    """Three hot keys, one of them NULL: each task passes on one row per key."""
    rows = t.orders.select("o_orderkey", "o_custkey",
                           F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return D.drop_exact(rows, ["status"], ["o_orderkey"])


@query(f"""SELECT doc_id, {squeezed('lang')} || '|' || {squeezed('source')} || '|' ||
       {squeezed('text')} AS fingerprint FROM documents""")
def fingerprints(t):
    return t.documents.select("doc_id", fingerprint(
        [F.col("lang"), F.col("source"), F.col("text")]).alias("fingerprint"))


@query()
def matching_ratios(t):
    """Similarity of each turn with the turn before it in the conversation."""
    turns = t.conversations
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", matching_ratio(fingerprint([F.col("text")], None),
                                          fingerprint([F.col("said")], None)).alias("ratio"))


@query(f"{near_sql('documents')} SELECT doc_id, leader FROM fp JOIN led USING (t)")
def near_duplicate_groups(t):
    return N.near_duplicate_groups(t.documents, ["text"], "doc_id", unit="word")


@query(f"{kept_sql('documents')} SELECT * FROM kept")
def near_duplicates_removed(t):
    return N.drop_near_duplicates(t.documents, ["text"], ["doc_id"], unit="word")


@query(f"""SELECT l_orderkey, l_linenumber, (CASE WHEN l_tax = 0 THEN 1 ELSE 0 END
       + CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)::INTEGER AS gaps,
       {r('(4 - CASE WHEN l_tax = 0 THEN 1 ELSE 0 END - CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)'
          ' / 4e0')} AS complete FROM lineitem""")
def row_completeness(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return rounded(rows.select("l_orderkey", "l_linenumber", D.null_count(rows).alias("gaps"),
                               D.completeness(rows).alias("complete")))


def _mode_per_key(key, value, source):
    return f"""(SELECT {key}, {value} FROM (SELECT {key}, {value}, row_number() OVER (
        PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS rn FROM {source}
        GROUP BY {key}, {value}) WHERE rn = 1)"""


@query(f"""SELECT o.o_orderkey, o.o_custkey, s.o_orderstatus, p.o_orderpriority FROM orders o
       JOIN {_mode_per_key('o_custkey', 'o_orderstatus', 'orders')} s USING (o_custkey)
       JOIN {_mode_per_key('o_custkey', 'o_orderpriority', 'orders')} p USING (o_custkey)""")
def conflicts_resolved(t):
    return D.resolve_conflicts(t.orders.select("o_orderkey", *KEYED), "o_custkey",
                               ["o_orderstatus", "o_orderpriority"])


@query("""SELECT * EXCLUDE rn FROM (SELECT o_custkey, o_orderkey, d AS o_orderdate, row_number() OVER (
       PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, o_orderkey) AS rn FROM (SELECT o_custkey,
       o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders)) WHERE rn = 1""")
def latest_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(
        F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate"))
    return D.keep_latest(rows, "o_orderdate", ["o_custkey"], ["o_orderkey"])


@query("""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
       (o_orderpriority IS NULL)::INT + (o_totalprice IS NULL)::INT, o_orderkey) AS rn FROM (
       SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
       CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS o_totalprice FROM orders)) WHERE rn = 1""")
def most_complete_per_key(t):
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") < 250000, F.col("o_totalprice")).alias("o_totalprice"))
    return D.keep_most_complete(rows, ["o_custkey"], ["o_orderkey"])


COPIES = f"(SELECT {KEYS}, count(*) AS copies FROM orders GROUP BY ALL)"


@query(f"""SELECT sum(copies)::BIGINT AS total_rows, sum(copies - 1)::BIGINT AS duplicate_rows,
       {r('sum(copies - 1)::DOUBLE / sum(copies)::DOUBLE * 100')} AS duplicate_percentage FROM {COPIES}""")
def duplicate_summary(t):
    return rounded(D.duplicate_summary(orders(t)))


LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_shipdate"]


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (count(*) - count(DISTINCT x)
        - (count(*) > count(x))::BIGINT)::BIGINT AS duplicates
        FROM (SELECT {"nullif(l_tax, 0e0)" if c == "l_tax" else c} AS x FROM lineitem)"""
    for c in LINE) + ") WHERE duplicates > 0")
def duplicate_columns(t):
    return D.duplicate_columns(t.lineitem.select(*LINE).withColumn(
        "l_tax", F.nullif("l_tax", F.lit(0.0))))


@query(f"SELECT * FROM {COPIES} WHERE copies > 1")
def duplicate_groups(t):
    return D.duplicate_groups(orders(t))


@query(f"""SELECT o_orderkey, {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY o_orderkey) > 1
       AS is_duplicate FROM orders""")
def repeated_rows_marked(t):
    return D.mark_duplicates(t.orders.select("o_orderkey", *KEYED), ["o_orderkey"])


@query(f"""SELECT o_orderkey, {KEYS}, count(*) OVER (PARTITION BY {KEYS}) > 1 AS is_duplicate
       FROM orders""")
def rows_with_copies_marked(t):
    return D.mark_duplicates(t.orders.select("o_orderkey", *KEYED), ["o_orderkey"], keep=False)


SALES = """(SELECT o_orderkey AS n, o_custkey AS transaction_id, o_orderpriority AS product,
            o_orderstatus AS category, o_orderdate AS order_date FROM orders)"""
SETTLED = f"""(SELECT s.n, s.transaction_id, p.product, c.category, s.order_date FROM {SALES} s
    JOIN {_mode_per_key('transaction_id', 'product', SALES)} p USING (transaction_id)
    JOIN {_mode_per_key('transaction_id', 'category', SALES)} c USING (transaction_id))"""
FIRSTS = f"""(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id,
    product, category, order_date ORDER BY n) AS rn FROM {SETTLED}) WHERE rn = 1)"""
LASTS = f"""(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
    ORDER BY n DESC) AS rn FROM {FIRSTS}) WHERE rn = 1)"""


def sales(t):
    return t.orders.select(
        F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("transaction_id"),
        F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("category"),
        F.col("o_orderdate").alias("order_date"))


@query(f"SELECT * FROM {LASTS}")
def deduplicated_sales(t):
    """Conflicts, exact duplicates and one row per key, under the sales preset."""
    return D.deduplicate(sales(t), "sales", order_by=["n"], remove_near=False).df


@query(f"""WITH c AS (SELECT (SELECT count(*) FROM {SALES}) AS a, (SELECT count(*) FROM {FIRSTS}) AS b,
         (SELECT count(*) FROM {LASTS}) AS d)
       SELECT 'inconsistent_duplicates' AS step, a AS before, b AS after, a - b AS removed FROM c
       UNION ALL SELECT 'exact_duplicates', b, d, b - d FROM c
       UNION ALL SELECT 'auto_resolve', d, d, 0 FROM c
       UNION ALL SELECT 'total', a, d, a - d FROM c""")
def dedup_report(t):
    return D.deduplicate(sales(t), "sales", order_by=["n"], remove_near=False).report()


@query(f"{kept_sql(first_sql('documents'))} SELECT * FROM kept")
def deduplicated_documents(t):
    """The full run with its near-duplicate step, over whole documents."""
    return D.deduplicate(t.documents, order_by=["doc_id"], near_columns=["text"], near_unit="word").df
