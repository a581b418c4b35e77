"""Dashboard data."""

from pyspark.sql import functions as F

from quiltframe.operators import summaries as S
from quiltframe.operators.quality import quality_report
from workloads.base import query, r, rounded, union_all
from workloads.scores import PARTS, REPORT_ROLES

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
       "ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 500")
def scatter_sample(t):
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return S.scatter(t.lineitem, "l_quantity", "l_extendedprice", order)


@query(f"""SELECT i::INTEGER AS i, {r('lo + (hi - lo) * i / 99e0')} AS x,
       {r('b + m * (lo + (hi - lo) * i / 99e0)', 2)} AS y FROM
       (SELECT regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b,
        min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), range(100) g(i)""")
def linear_trend(t):
    return S.linear_trend(t.lineitem, "l_quantity", "l_extendedprice").select(
        "i", F.round("x", 4).alias("x"), F.round("y", 2).alias("y"))


@query(union_all([f"SELECT '{a}' AS a, '{b}' AS b, "
                  + (r(f"corr({a}, {b})", 6) if a != b else "1e0")
                  + " AS r FROM " + ("lineitem" if a != b else "(SELECT 1)")
                  for a in NUMBERS for b in NUMBERS]))
def correlation_matrix(t):
    return rounded(S.correlation_matrix(t.lineitem.select(*NUMBERS)), 6)


@query(f"""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m FROM orders),
       c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 3e1))::INTEGER, 29) AS bin, count(*) AS n
             FROM orders, e GROUP BY 1)
       SELECT g.i::INTEGER AS bin, {r('lo + i * ((hi - lo) / 3e1)', 2)} AS low,
       {r('lo + (i + 1) * ((hi - lo) / 3e1)', 2)} AS high, coalesce(n, 0) AS n, {r('m', 2)} AS mean
       FROM e, range(30) g(i) LEFT JOIN c ON c.bin = g.i""")
def histogram(t):
    return rounded(S.histogram(t.orders, "o_totalprice"), 2)


@query("""SELECT 'l_tax' AS "column", count(*) - count(nullif(l_tax, 0e0)) AS missing FROM lineitem
       UNION ALL SELECT 'l_returnflag', count(*) - count(nullif(l_returnflag, 'R')) FROM lineitem""")
def missing_values(t):
    return S.missing_values(t.lineitem.withColumns({
        "l_tax": F.nullif("l_tax", F.lit(0.0)), "l_returnflag": F.nullif("l_returnflag", F.lit("R"))}))


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "TIMESTAMP": "timestamp_ntz"}


@query("SELECT CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
       + " END AS type, count(*) AS columns, (count(*) * (SELECT count(*) FROM lineitem))::BIGINT AS cells "
         "FROM (DESCRIBE lineitem) GROUP BY 1")
def type_counts(t):
    return S.type_counts(t.lineitem)


def _outliers(c, source):
    return f"""SELECT '{c}' AS "column", {r('q1 - 1.5e0 * (q3 - q1)')} AS low,
        {r('q3 + 1.5e0 * (q3 - q1)')} AS high,
        (SELECT count(*) FROM {source} WHERE {c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)) AS outliers
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"""


@query(union_all([_outliers("value", "events"), _outliers("user_id", "events")]))
def iqr_outliers(t):
    return rounded(S.iqr_outliers(t.events.select("value", "user_id")))


def _spread(f, name, limit):
    return ("SELECT * FROM (" + union_all([
        f"""SELECT '{c}' AS "column", {r(f'{f}({c})')} AS {name} FROM lineitem""" for c in NUMBERS])
        + f") ORDER BY {name} DESC LIMIT {limit}")


@query(_spread("stddev_samp", "std", 10))
def top_deviations(t):
    return rounded(S.top_deviations(t.lineitem.select(*NUMBERS)))


@query(_spread("var_samp", "variance", 3).replace("4) + 0e0", "1) + 0e0"))
def top_variances(t):
    return rounded(S.top_variances(t.lineitem.select(*NUMBERS), 3), 1)


@query(union_all([f"""SELECT '{c}' AS "column", {r(f'quantile_cont({c}, 0.25)')} AS q1,
       {r(f'quantile_cont({c}, 0.5)')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3,
       {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std FROM lineitem""" for c in NUMBERS]))
def box_summary(t):
    return rounded(S.box_summary(t.lineitem.select(*NUMBERS)))


def balances(t):
    return (t.customer.select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")),
            t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")))


BOTH = """(SELECT 'original' AS source, c_acctbal AS balance, c_nationkey::DOUBLE AS nation FROM customer
           UNION ALL SELECT 'synthetic', s_acctbal, s_nationkey::DOUBLE FROM supplier)"""


@query(f"""WITH x AS {BOTH}, e AS (SELECT min(balance) AS lo, max(balance) AS hi FROM x),
       c AS (SELECT source, least(floor((balance - lo) / ((hi - lo) / 2e1))::INTEGER, 19) AS bin, count(*) AS n
             FROM x, e GROUP BY ALL)
       SELECT s.source, g.i::INTEGER AS bin, {r('lo + i * (hi - lo) / 2e1')} AS low, coalesce(n, 0) AS n
       FROM e, range(20) g(i), (SELECT DISTINCT source FROM x) s
       LEFT JOIN c ON c.bin = g.i AND c.source = s.source""")
def compare_distribution(t):
    return rounded(S.compare_distribution(*balances(t), "balance"))


@query(f"""SELECT source, {r('(avg(balance) + avg(nation)) / 2')} AS mean,
       {r('(stddev_samp(balance) + stddev_samp(nation)) / 2')} AS std,
       least(min(balance), min(nation)) AS min, greatest(max(balance), max(nation)) AS max
       FROM {BOTH} GROUP BY source""")
def compare_statistics(t):
    return rounded(S.compare_statistics(*balances(t)))


def _corr(a, b, source):
    return "1e0" if a == b else f"(SELECT corr({a}, {b}) FROM {BOTH} WHERE source = '{source}')"


@query(union_all([f"SELECT '{a}' AS a, '{b}' AS b, {r(_corr(a, b, 'original'), 6)} AS r_original, "
                  f"{r(_corr(a, b, 'synthetic'), 6)} AS r_synthetic"
                  for a in ("balance", "nation") for b in ("balance", "nation")]))
def compare_correlations(t):
    return rounded(S.compare_correlations(*balances(t)), 6)


@query(union_all([f"SELECT '{m}' AS metric, {r(f'{PARTS[m]} * 1e2', 3)} AS percent"
                  for m in ("completeness", "uniqueness", "privacy_score")]))
def metric_percentages(t):
    return rounded(S.metric_percentages(quality_report(t.orders, roles=REPORT_ROLES)), 3)

