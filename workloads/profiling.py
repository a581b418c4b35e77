"""Column statistics, types, roles and summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe import constants as K
from quiltframe.operators import profile as P
from workloads.base import query, r, rounded, union_all
from workloads.sqltext import SPACE, strip, text

# Text columns profiled, per table, with the expression that derives each.
PROFILED = {
    "customer": {"c_name": "c_name", "c_mktsegment": "c_mktsegment"},
    "orders": {"o_orderpriority": "o_orderpriority", "order_day": "strftime(o_orderdate, '%Y-%m-%d')"},
    "part": {"p_name": "p_name", "p_type": "p_type", "size_text": "CAST(p_size AS VARCHAR)"},
    "supplier": {"s_code": "'SUP-' || CAST(s_suppkey AS VARCHAR)",
                 "s_mail": "'s' || CAST(s_suppkey AS VARCHAR) || '@parts.example.com'",
                 "s_active": "CASE WHEN s_acctbal > 0 THEN 'yes' ELSE 'No' END"},
    "documents": {"text": "text", "lang": "lang", "source": "source"},
    "conversations": {"role": "role", "text": "text"},
}


def profiled(t, table: str) -> DataFrame:
    df = getattr(t, table)
    derived = {
        "order_day": F.date_format("o_orderdate", "yyyy-MM-dd") if table == "orders" else None,
        "size_text": F.col("p_size").cast("string") if table == "part" else None,
    }
    if table == "supplier":
        key = F.col("s_suppkey").cast("string")
        derived = {
            "s_code": F.concat(F.lit("SUP-"), key),
            "s_mail": F.concat(F.lit("s"), key, F.lit("@parts.example.com")),
            "s_active": F.when(F.col("s_acctbal") > 0, "yes").otherwise("No")}
    return df.select(*[(derived[c] if derived.get(c) is not None else F.col(c)).alias(c)
                       for c in PROFILED[table]])


def _stats_sql(table: str, name: str, expression: str) -> str:
    words = ", ".join(text(w) for w in K.BOOLEAN_WORDS)
    date = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
    return f"""SELECT '{table}' AS "table", '{name}' AS "column", count(*) AS n_rows,
        count(v) AS n_values, count(DISTINCT v) AS n_distinct,
        {r(f"avg(regexp_matches(v, '{K.EMAIL_CELL}')::INT)")} AS email_share,
        {r(f"avg(regexp_matches(v, '{K.ID_CELL}')::INT)")} AS id_share,
        {r(f"avg((lower(v) IN ({words}))::INT)")} AS boolean_share,
        {r(f"avg((regexp_matches(v, '{date}') AND try_cast(v AS TIMESTAMP) IS NOT NULL)::INT)")} AS date_share,
        {r("avg((try_cast(v AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(v AS DOUBLE)))::INT)")} AS number_share,
        {r("avg(length(v))")} AS avg_length,
        {r(f"avg(CASE WHEN v = '' THEN 0 ELSE len(string_split_regex(v, '{SPACE}+')) END)")} AS avg_words
        FROM (SELECT {strip(expression)} AS v FROM {table})"""


@query(union_all([_stats_sql(t, n, e) for t, cols in PROFILED.items() for n, e in cols.items()]))
def column_stats(t):
    parts = [P.column_stats(profiled(t, name)).select(F.lit(name).alias("table"), "*")
             for name in PROFILED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


# The types and roles these tables must get, as conditions on their statistics.
KINDS = """CASE WHEN regexp_matches("column", '{ids}') THEN 'id'
    WHEN n_distinct >= 0.9 * n_values AND id_share >= 0.7 THEN 'id'
    WHEN boolean_share >= 0.8 THEN 'categorical' WHEN date_share > 0.8 THEN 'datetime'
    WHEN number_share = 1 THEN 'numeric' ELSE 'categorical' END""".format(ids=K.ID_COLUMN_FIT)
ROLES = """CASE WHEN type <> 'categorical' THEN type WHEN email_share > 0.6 THEN 'email'
    WHEN n_distinct BETWEEN 1 AND greatest(25, floor(0.5 * n_values)) AND
      (regexp_matches("column", 'type|mode|priority|status') OR n_distinct < 0.55 * n_values)
      THEN 'closed_categorical'
    WHEN "column" IN ('title', 'role') THEN 'job'
    WHEN avg_length <= 40 AND avg_words <= 6 THEN 'closed_categorical' ELSE 'text_open' END"""
REPORT_ROLES = """CASE WHEN date_share > 0.8 THEN 'datetime' WHEN email_share > 0.6 THEN 'email'
    WHEN n_distinct < 0.55 * n_values THEN 'closed_categorical' ELSE 'text_open' END"""
STATS_SQL = union_all([_stats_sql(t, n, e) for t, cols in PROFILED.items() for n, e in cols.items()])


@query(f"""SELECT "table", "column", type, {ROLES} AS role FROM (
       SELECT *, {KINDS} AS type FROM ({STATS_SQL}))""")
def column_types_and_roles(t):
    parts = [P.column_profile(profiled(t, name)).select(F.lit(name).alias("table"), "*")
             for name in PROFILED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""SELECT "table", "column", {REPORT_ROLES} AS role FROM ({STATS_SQL})""")
def report_roles(t):
    rows = [(name, c, role) for name in PROFILED
            for c, role in P.infer_report_roles(profiled(t, name)).items()]
    return t.spark.createDataFrame(rows, "table string, column string, role string")


CITY_CASE = "CASE WHEN c_nationkey < 10 THEN list_value({})[c_nationkey + 1] ELSE 'Nation ' || c_nationkey END".format(
    ", ".join(text(c) for c in K.INDIA_CITIES[:10]))
PHONE_CASE = "CASE WHEN c_acctbal > 5000 THEN '+91 ' ELSE '' END || printf('%010d', c_custkey)"


def people(t):
    city = F.when(F.col("c_nationkey") < 10, F.element_at(
        F.array(*[F.lit(c) for c in K.INDIA_CITIES[:10]]), F.least(F.col("c_nationkey"), F.lit(9)) + 1
    )).otherwise(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")))
    phone = F.concat(F.when(F.col("c_acctbal") > 5000, "+91 ").otherwise(""),
                     F.format_string("%010d", "c_custkey"))
    mail = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@ "),
                    F.initcap("c_mktsegment"), F.lit(".com"))
    return t.customer.select(city.alias("home_city"), phone.alias("phone"), mail.alias("email"))


@query(f"""SELECT {r(f"avg(regexp_matches(lower(c), '{'|'.join(K.INDIA_CITY_HINTS)}')::INT)")} AS hints,
       {r("avg(starts_with(d, '91')::INT)")} AS starts_91, {r("avg((length(d) = 10)::INT)")} AS ten_digits
       FROM (SELECT {CITY_CASE} AS c, regexp_replace({PHONE_CASE}, '[^0-9]', '', 'g') AS d FROM customer)""")
def india_context_shares(t):
    df = people(t)
    return rounded(df.agg(P.city_hint_share(df, "home_city").alias("hints"),
                          *P.phone_style_stats("phone")))


@query("SELECT DISTINCT lower(c_mktsegment) || '.com' AS domain FROM customer")
def email_domains(t):
    return P.email_domains(people(t), ["email"])


LINE = {"l_orderkey": "bigint", "l_tax": "double", "l_quantity": "double", "l_returnflag": "string",
        "l_shipdate": "timestamp_ntz"}


def line(t):
    return t.lineitem.select(*LINE).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))


def _line_value(c):
    return "nullif(l_tax, 0e0)" if c == "l_tax" else c


@query(union_all([f"""SELECT '{c}' AS "column", '{k}' AS type, count(DISTINCT {_line_value(c)}) AS "unique",
       {r(f'(count(*) - count({_line_value(c)})) * 1e2 / count(*)', 2)} AS null_pct FROM lineitem"""
                  for c, k in LINE.items()]))
def column_summary(t):
    return P.column_summary(line(t))


@query("""WITH x AS (SELECT o_custkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
       SELECT count(*) AS total_records, 3::BIGINT AS total_columns, 1::BIGINT AS numeric_columns,
       2::BIGINT AS categorical_columns, (count(*) - count(p))::BIGINT AS missing_values,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)))::BIGINT AS duplicate_rows FROM x""")
def table_profile(t):
    return P.table_profile(t.orders.select(
        "o_custkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")))


def _describe(c, e, source="lineitem"):
    return f"""SELECT '{c}' AS "column", count(x) AS "count", {r('avg(x)')} AS mean,
        {r('stddev_samp(x)')} AS std, min(x)::DOUBLE AS min, {r('quantile_cont(x, 0.25)')} AS q25,
        {r('quantile_cont(x, 0.5)')} AS q50, {r('quantile_cont(x, 0.75)')} AS q75,
        max(x)::DOUBLE AS max FROM (SELECT {e} AS x FROM {source})"""


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(union_all([_describe(c, _line_value(c)) for c in NUMBERS]))
def describe_numeric(t):
    df = t.lineitem.select(*NUMBERS).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return rounded(P.describe_numeric(df))
