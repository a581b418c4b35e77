"""Template queries: one made row per row of a given table."""

from pyspark.sql import functions as F

from quiltframe.plans.template_specs import TEMPLATES
from quiltframe.plans.templates import AS_OF, generate_template, make_rows, rows_of, spread
from workloads.base import ORACLES, QUERIES, Tables, r, rounded
from workloads.sqltext import template_sql

# Query, template, table and key that give the row ids.
MADE = [
    ("template_personal", "Personal/Customer Data", "customer", "c_custkey"),
    ("template_sales", "Sales Transactions", "orders", "o_orderkey"),
    ("template_employee", "Employee Records", "supplier", "s_suppkey"),
    ("template_time_series", "Time Series Data", "orders", "o_orderkey"),
    ("template_logs", "Application Logs", "events", "event_id"),
    ("template_system_metrics", "System Metrics", "events", "event_id"),
    ("template_correlated_vm", "Correlated VM Data", "events", "event_id"),
    ("template_iot", "IoT Sensor Data", "events", "event_id"),
    ("template_healthcare", "Healthcare Records", "customer", "c_custkey"),
    ("template_financial", "Financial Transactions", "orders", "o_orderkey"),
    ("template_toll", "Toll Plaza Data", "orders", "o_orderkey"),
]
OVERRIDES = {
    "Time Series Data": {
        "date": "CAST('{as_of}' AS TIMESTAMP) + to_days(CAST(row_id - {n} AS INTEGER))"},
    "Correlated VM Data": {
        "timestamp": "CAST('{as_of}' AS TIMESTAMP) - to_minutes(5 * row_id)"},
    "Toll Plaza Data": {
        "_vslot": "('0x' || substr(md5(Vehicle_Number), 1, 7))::BIGINT % 6"},
}
SERIES = ["date", "value", "moving_avg_7d", "moving_avg_30d", "volatility", "anomaly",
          "series_2", "series_3"]


def _sql(template: str, table: str, key: str) -> str:
    specs, source = TEMPLATES[template], f"SELECT {key}::BIGINT AS row_id FROM {table}"
    n = f"(SELECT count(*) FROM {table})"
    body = template_sql(template, specs, source, AS_OF, n, OVERRIDES.get(template))
    names = [c for c in specs if not c.startswith("_")]
    if template == "Time Series Data":
        body = f"""SELECT *,
            avg(value) OVER (ORDER BY row_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg_7d,
            avg(value) OVER (ORDER BY row_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS moving_avg_30d,
            sum(_step) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS series_3 FROM ({body})"""
        doubles = {"value", "moving_avg_7d", "moving_avg_30d", "volatility", "series_2", "series_3"}
        columns = [f"{r(c, 6)} AS {c}" if c in doubles else f'"{c}"' for c in SERIES]
    else:
        columns = [f'"{c}"' for c in names]
    return f"SELECT row_id, {', '.join(columns)} FROM ({body})"


def _register(name, template, table, key):
    def run(spark, folder):
        made = make_rows(spread(rows_of(getattr(Tables(spark, folder), table), key)), template)
        return rounded(made, 6) if template == "Time Series Data" else made

    QUERIES[name] = run
    ORACLES[name] = _sql(template, table, key)


for entry in MADE:
    _register(*entry)


def template_subset(spark, folder):
    """The reduced personal and sales tables: a choice of template columns."""
    return make_rows(spread(rows_of(Tables(spark, folder).orders, "o_orderkey")), "Sales Transactions",
                     columns=["product", "quantity", "unit_price", "total", "region", "rating"])


QUERIES["template_subset"] = template_subset
ORACLES["template_subset"] = (
    "SELECT row_id, product, quantity, unit_price, total, region, rating FROM ("
    + ORACLES["template_sales"] + ")")


def template_means(spark, folder):
    """Means of a made table, computed without writing it out."""
    keys = Tables(spark, folder).lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    made = make_rows(spread(rows_of(keys, "k")), "System Metrics")
    return rounded(made.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cpu_usage").alias("cpu"),
        F.avg("memory_usage").alias("memory")))


QUERIES["template_means"] = template_means
ORACLES["template_means"] = (
    f"SELECT hostname, count(*)::BIGINT AS n, {r('avg(cpu_usage)')} AS cpu, "
    f"{r('avg(memory_usage)')} AS memory FROM ("
    + _sql("System Metrics", "(SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem)", "k")
    + ") GROUP BY hostname")


def template_cleaned(spark, folder):
    """The template pipeline: as many log rows as there are orders, validated, cleaned, gaps filled, none dropped."""
    return generate_template(spark, "Application Logs", Tables(spark, folder).orders.count(),
                             cleaned=True, fill=["error_message"])


def _cleaned_sql():
    names = [c for c in TEMPLATES["Application Logs"] if not c.startswith("_") and c != "error_message"]
    body = _sql("Application Logs", "(SELECT unnest(range((SELECT count(*) FROM orders))) AS k)", "k")
    return f"""WITH made AS ({body}) SELECT {', '.join(f'"{c}"' for c in names)}, coalesce(error_message,
        (SELECT error_message FROM made WHERE error_message IS NOT NULL GROUP BY 1
         ORDER BY count(*) DESC, 1 LIMIT 1)) AS error_message FROM made"""


QUERIES["template_cleaned"] = template_cleaned
ORACLES["template_cleaned"] = _cleaned_sql()

# The reduced tables of the other templates: query, full query, its table, columns.
REDUCED = [
    ("template_personal_subset", "template_personal", ["first_name", "last_name", "email", "phone", "city", "age"]),
    ("template_logs_subset", "template_logs", ["timestamp", "log_level", "service", "message", "status_code"]),
    ("template_iot_subset", "template_iot", ["timestamp", "temperature", "humidity", "battery_level"]),
]


def _register_reduced(name, whole, columns):
    template, table, key = next(m[1:] for m in MADE if m[0] == whole)
    columns = [c for c in TEMPLATES[template] if c in columns]

    def run(spark, folder):
        return make_rows(spread(rows_of(getattr(Tables(spark, folder), table), key)), template, columns=columns)

    QUERIES[name] = run
    chosen = ", ".join(f'"{c}"' for c in columns)
    ORACLES[name] = f"SELECT row_id, {chosen} FROM ({ORACLES[whole]})"


for entry in REDUCED:
    _register_reduced(*entry)
