"""Validation and cleaning."""

from pyspark.sql import functions as F

from quiltframe.functions.numbers import clip, finalize_numeric
from quiltframe.functions.text import edit_similarity
from quiltframe.operators import clean as C
from quiltframe.operators import validate as V
from quiltframe.operators.fit import NumericModel
from workloads.base import query, r, rounded
from workloads.neartext import first_sql, kept_sql
from workloads.sqltext import strip

INF = "'Infinity'::DOUBLE"
GAPPED = """(SELECT l_orderkey, l_linenumber, nullif(l_tax, 0e0) AS l_tax,
             CASE WHEN l_quantity <> 50 THEN l_quantity END AS l_quantity,
             CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS l_part FROM lineitem)"""


def gapped(t):
    """lineitem with gaps where the tax is zero, the quantity 50, or the line the seventh."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_quantity") != 50, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("l_part"))


@query(f"""WITH x AS (SELECT l_orderkey, nullif(l_tax, 0e0) AS l_tax,
             CASE WHEN l_discount = 0 THEN {INF} ELSE l_discount END AS l_discount FROM lineitem)
       SELECT 'rows' AS "check", NULL::VARCHAR AS "column", count(*)::DOUBLE AS value,
              count(*) > 0 AS passed FROM x
       UNION ALL SELECT 'columns', NULL, 3e0, true
       UNION ALL SELECT 'null_share', NULL, {r('(count(*) - count(l_tax)) / (count(*) * 3)::DOUBLE')},
              true FROM x
       UNION ALL SELECT 'infinite', 'l_tax', 0e0, true
       UNION ALL SELECT 'infinite', 'l_discount', count(CASE WHEN l_discount = {INF} THEN 1 END)::DOUBLE,
              count(CASE WHEN l_discount = {INF} THEN 1 END) = 0 FROM x""")
def check_table(t):
    table = t.lineitem.select(
        "l_orderkey", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount"))
        .alias("l_discount"))
    return rounded(V.check_table(table))


@query("""SELECT 'rows' AS "check", NULL::VARCHAR AS "column", count(*)::DOUBLE AS value,
              count(*) >= 2 AS passed FROM labels
       UNION ALL SELECT 'columns', NULL, 3e0, true
       UNION ALL SELECT 'filled', 'doc_id', count(doc_id)::DOUBLE, count(doc_id) > 0 FROM labels
       UNION ALL SELECT 'filled', 'quality', count(quality)::DOUBLE, count(quality) > 0 FROM labels
       UNION ALL SELECT 'filled', 'spoiled', 0e0, false""")
def check_sample(t):
    return V.check_sample(t.labels.select(
        "doc_id", "quality", F.when(F.col("toxic") > 1, F.col("toxic")).alias("spoiled")))


@query(f"""WITH x AS (SELECT count(*)::BIGINT AS n, {r('sum(o_totalprice)', 1)} AS total FROM orders)
       SELECT * FROM x UNION ALL SELECT * FROM x""")
def widen_sample(t):
    return rounded(V.widen_sample(t.orders.agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))), 1)


@query(f"""SELECT l_orderkey, l_linenumber,
       coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM {GAPPED})) AS l_tax,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {GAPPED})) AS l_quantity,
       coalesce(l_part, (SELECT quantile_cont(l_part, 0.5)::INTEGER FROM {GAPPED})) AS l_part
       FROM {GAPPED}""")
def fill_median(t):
    return C.fill_median(gapped(t), ["l_tax", "l_quantity", "l_part"])


LARGE = """(SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber <> 7 THEN 9007199254740993 + 2 * (l_orderkey * 1000003 + l_partkey) END AS code,
    CASE WHEN l_tax > 0 THEN l_extendedprice::DECIMAL(18,2) END AS price,
    CASE WHEN l_tax > 0 THEN l_partkey::DECIMAL(30,3) * 1000000007 + 0.125::DECIMAL(30,3) END AS wide FROM lineitem)"""


def _middle(column):
    """The mean of the two middle values, without rounding."""
    one = f"(SELECT {column} FROM {LARGE} WHERE {column} IS NOT NULL ORDER BY 1 LIMIT 1 OFFSET {{}})"
    n = f"(SELECT count({column}) FROM {LARGE})"
    return one.format(f"(SELECT ({n} - 1) // 2)"), one.format(f"(SELECT {n} // 2)")


@query(f"""WITH m AS (SELECT {_middle('code')[0]} AS a, {_middle('code')[1]} AS b,
         {_middle('price')[0]} AS c, {_middle('price')[1]} AS d, {_middle('wide')[0]} AS e, {_middle('wide')[1]} AS f)
       SELECT l_orderkey, l_linenumber, coalesce(code, a + (b - a) // 2) AS code,
         (coalesce(price, 0) * 1000)::BIGINT + CASE WHEN price IS NULL THEN ((c + d) * 500)::BIGINT ELSE 0 END AS price,
         (coalesce(wide, 0) * 10000)::DECIMAL(38,0)::VARCHAR AS wide,
         (wide IS NULL)::INTEGER AS gap
       FROM {LARGE}, m WHERE wide IS NOT NULL
       UNION ALL SELECT l_orderkey, l_linenumber, coalesce(code, a + (b - a) // 2), ((c + d) * 500)::BIGINT,
         ((e + f) * 5000)::DECIMAL(38,0)::VARCHAR, 1 FROM {LARGE}, m WHERE wide IS NULL""")
def fill_median_exact(t):
    """Medians of whole numbers above 2^53 and of decimals, each in its own type."""
    large = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.lit(9007199254740993) + 2 * (
            F.col("l_orderkey") * 1000003 + F.col("l_partkey"))).alias("code"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"),
        F.when(F.col("l_tax") > 0, F.col("l_partkey").cast("decimal(17,3)") * F.lit(1000000007).cast("decimal(10,0)")
               + F.lit("0.125").cast("decimal(4,3)")).cast("decimal(30,3)").alias("wide"))
    filled = C.fill_median(large.withColumn("gap", F.col("wide").isNull().cast("int")), ["code", "price", "wide"])
    return filled.select(
        "l_orderkey", "l_linenumber", "code", (F.col("price") * 1000).cast("bigint").alias("price"),
        (F.col("wide") * 10000).cast("decimal(38,0)").cast("string").alias("wide"), "gap")


def _mode(column, source):
    return (f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


PRIORITIES = """(SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority,
                 nullif(o_orderstatus, 'O') AS o_orderstatus FROM orders)"""


@query(f"""SELECT o_orderkey, coalesce(o_orderpriority, {_mode('o_orderpriority', PRIORITIES)})
       AS o_orderpriority, coalesce(o_orderstatus, {_mode('o_orderstatus', PRIORITIES)})
       AS o_orderstatus, 'Unknown' AS note FROM {PRIORITIES}""")
def fill_mode(t):
    orders = t.orders.select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"),
        F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"),
        F.nullif("o_orderstatus", "o_orderstatus").alias("note"))
    return C.fill_mode(orders)


@query(f"""SELECT conv_id, turn, nullif({strip("CASE role WHEN 'user' THEN '  ' || text || chr(10) "
       "ELSE ' ' || chr(9) END")}, '') AS text FROM conversations""")
def strip_text(t):
    padded = F.when(F.col("role") == "user", F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(" \t")
    return C.strip_text(t.conversations.select("conv_id", "turn", padded.alias("text")))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FALSE' ELSE o_orderstatus END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'TRUE' WHEN '2-HIGH' THEN 'FALSE' WHEN '3-MEDIUM' THEN 'TRUE'
       ELSE 'Maybe' END AS label, CASE WHEN o_totalprice > 250000 THEN 'TRUE' ELSE 'FALSE' END AS dear
       FROM orders""")
def unify_booleans(t):
    priority = F.col("o_orderpriority")
    orders = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.when(priority == "1-URGENT", " Yes").when(priority == "2-HIGH", "no")
        .when(priority == "3-MEDIUM", "T ")
        .otherwise(" Maybe ").alias("label"), (F.col("o_totalprice") > 250000).alias("dear"))
    return C.unify_booleans(orders)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS order_date,
       o_orderdate::DATE::TIMESTAMP AS ship_time, o_totalprice AS lifetime_value FROM orders""")
def cast_named_dates(t):
    shown = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
             .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "M/d/yyyy"))
             .otherwise("not known"))
    return C.cast_named_dates(t.orders.select(
        "o_orderkey", shown.alias("order_date"), F.to_date("o_orderdate").alias("ship_time"),
        F.col("o_totalprice").alias("lifetime_value")))


@query("""SELECT l_orderkey, l_linenumber,
       round_even(greatest(least(coalesce(nullif(l_extendedprice, 0e0), 5e4), 8e4), 1e3), 2) AS price,
       greatest(least(round_even(greatest(least(l_extendedprice * 1e1, 9e5), 2e5), 0)::BIGINT,
       999999), 100000)::BIGINT AS code FROM lineitem""")
def finalize_numeric_columns(t):
    price = NumericModel(9, 5e4, 1.0, 1e3, 8e4, 2, False)
    code = NumericModel(9, 5e5, 1.0, 2e5, 9e5, 0, True)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        finalize_numeric(F.nullif("l_extendedprice", F.lit(0.0)), price).alias("price"),
        finalize_numeric(F.col("l_extendedprice") * 10, code).alias("code"))


@query("""SELECT o_orderkey, greatest(least(o_totalprice, 3e5), 1e5) AS price,
       greatest(least(o_orderdate, TIMESTAMP '1997-06-30'), TIMESTAMP '1994-01-01') AS day
       FROM orders""")
def clip_columns(t):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1994-01-01", "1997-06-30"))
    return t.orders.select(
        "o_orderkey", clip(F.col("o_totalprice"), 1e5, 3e5).alias("price"),
        clip(F.col("o_orderdate"), low, high).alias("day"))


PADDED = """(SELECT c_nationkey, '  ' || c_mktsegment || ' ' AS segment,
             CASE WHEN c_acctbal > 0 THEN 'y' ELSE 'No ' END AS in_credit,
             CASE WHEN c_nationkey > 12 THEN 'f' ELSE c_mktsegment END AS code FROM customer)"""


@query(f"""SELECT DISTINCT c_nationkey, trim(segment) AS segment,
       CASE in_credit WHEN 'y' THEN 'TRUE' ELSE 'FALSE' END AS in_credit, code FROM {PADDED}""")
def prepare_sample(t):
    """Labels are unified where the whole column reads as yes/no, not in `code`."""
    return C.prepare_sample(t.customer.select(
        "c_nationkey", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, "y").otherwise("No ").alias("in_credit"),
        F.when(F.col("c_nationkey") > 12, "f").otherwise(F.col("c_mktsegment")).alias("code")))


CLEAN_INPUT = """(SELECT o_custkey AS customer, nullif(o_orderpriority, '5-LOW') AS priority,
    '  ' || o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
    strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders)"""


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY customer, priority, status, price,
              order_date) AS rn FROM {CLEAN_INPUT}),
       x AS (SELECT * FROM d WHERE rn = 1)
       SELECT customer, coalesce(priority, {_mode('priority', 'x')}) AS priority,
       trim(status) AS status, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM x)) AS price,
       order_date::TIMESTAMP AS order_date FROM x""")
def clean_table(t):
    """The whole cleaning run without the near-duplicate step."""
    orders = t.orders.select(
        F.col("o_custkey").alias("customer"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.concat(F.lit("  "), "o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))
    return C.clean(orders, dedup={"remove_near": False})


GAPPED_DOCUMENTS = """(SELECT doc_id, text, nullif(lang, 'fr') AS lang, source,
    CASE WHEN doc_id % 10 <> 0 THEN n_chars::DOUBLE END AS n_chars FROM documents)"""


@query(f"""{kept_sql(first_sql(GAPPED_DOCUMENTS))}
       SELECT doc_id, nullif({strip('text')}, '') AS text, coalesce(lang, {_mode('lang', 'kept')}) AS lang, source,
         coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM kept)) AS n_chars FROM kept""")
def clean_documents(t):
    """The whole cleaning run with its near-duplicate step."""
    documents = t.documents.select(
        "doc_id", "text", F.nullif("lang", F.lit("fr")).alias("lang"), "source",
        F.when(F.col("doc_id") % 10 != 0, F.col("n_chars").cast("double")).alias("n_chars"))
    return C.clean(documents, order_by=["doc_id"], dedup={"near_columns": ["text"], "near_unit": "word"})


CATALOG = {"1-URGENT": "Patient name", "2-HIGH": "Order_ID", "3-MEDIUM": "salary band",
           "4-NOT SPECIFIED": "notes", "5-LOW": "Policy no"}
CATALOG_CASE = " ".join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in CATALOG.items())


@query(f"""WITH m AS (SELECT o_custkey, CASE o_orderpriority {CATALOG_CASE} END AS n FROM orders)
       SELECT o_custkey AS "table", CASE
         WHEN bool_or(regexp_matches(n, 'patient|diagnosis|doctor|admission')) THEN 'healthcare'
         WHEN bool_or(regexp_matches(n, 'order_id|product|courier|shipping')) THEN 'ecommerce'
         WHEN bool_or(regexp_matches(n, 'employee|salary|department|designation')) THEN 'hr'
         WHEN bool_or(regexp_matches(n, 'upi|aadhaar|ifsc|kyc|account')) THEN 'banking'
         WHEN bool_or(regexp_matches(n, 'claim|policy|premium|insured')) THEN 'insurance'
         WHEN bool_or(regexp_matches(n, 'msisdn|churn|telecom|subscriber')) THEN 'telecom'
         WHEN bool_or(regexp_matches(n, 'crop|yield|farmer|acre')) THEN 'agriculture'
         ELSE 'unknown' END AS domain FROM m GROUP BY o_custkey""")
def domain_labels(t):
    """A catalog with one table per customer and one column per order."""
    names = F.create_map(*[F.lit(x) for pair in CATALOG.items() for x in pair])
    return C.domain_labels(t.orders.select(
        F.col("o_custkey").alias("table"), names[F.col("o_orderpriority")].alias("column")))


@query(f"""SELECT p_partkey, {r("CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1e0 "
       "ELSE 1e0 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), "
       "length(p_type))::DOUBLE END")} AS similarity FROM part""")
def edit_similarity_of_names(t):
    return rounded(t.part.select("p_partkey", edit_similarity(
        F.lower("p_name"), F.lower("p_type")).alias("similarity")))


