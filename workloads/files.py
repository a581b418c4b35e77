"""Round trips through files, the run log, and row numbering."""

from pyspark.sql import functions as F

from quiltframe.operators.ordered import dense_position, rolling_mean, running_sum
from quiltframe.operators.scratch import new_folder
from quiltframe.sources import files, runlog
from workloads.base import query, r, rounded


@query("SELECT * FROM orders")
def csv_round_trip(t):
    path = new_folder(t.spark, "csv")
    files.write_csv(t.orders, path)
    back = files.drop_time_zones(files.read_csv(t.spark, path))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in t.orders.schema.fields])


@query("SELECT * FROM documents")
def csv_texts_round_trip(t):
    """Whole texts with quotes, commas and line breaks."""
    path = new_folder(t.spark, "csv")
    files.write_csv(t.documents, path, rows_per_file=10_000)
    return files.read_csv(t.spark, path, t.documents.schema, multi_line=True)


@query("SELECT * FROM events")
def csv_times_round_trip(t):
    path = new_folder(t.spark, "csv")
    files.write_csv(t.events, path)
    return files.read_csv(t.spark, path, t.events.schema)


@query("SELECT * FROM events")
def json_times_round_trip(t):
    path = new_folder(t.spark, "json")
    files.write_json(t.events, path)
    return files.read_json(t.spark, path, t.events.schema)


@query("SELECT * FROM customer")
def json_round_trip(t):
    path = new_folder(t.spark, "json")
    files.write_json(t.customer, path)
    return files.read_json(t.spark, path, t.customer.schema)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def parquet_round_trip(t):
    """Written by return flag, read back whole."""
    path = new_folder(t.spark, "parquet")
    files.write_parquet(t.lineitem, path, partition_by=["l_returnflag"])
    return files.read_parquet(t.spark, path).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("""SELECT event_id, ts AS zoned, CASE event_type WHEN 'click' THEN ts - INTERVAL 330 MINUTE
          ELSE ts + INTERVAL 120 MINUTE END AS local, date_trunc('second', ts) - INTERVAL 330 MINUTE
          AS written FROM events""")
def drop_time_zones(t):
    events = t.events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'").alias("written"),
        "event_id", F.col("ts").cast("timestamp").alias("zoned"), F.col("ts").alias("local"),
        F.when(F.col("event_type") == "click", "+05:30").otherwise("-02:00").alias("zone"))
    return files.drop_time_zones(events, {"local": "zone"}, ["written"]).drop("zone")


@query(f"""SELECT CAST(ts AS VARCHAR) AS "timestamp", coalesce(event_type, 'Unknown') AS data_type,
           user_id AS records, 0::BIGINT AS columns, {r('value')} AS generation_time,
           0e0 AS quality_score FROM events ORDER BY event_id DESC LIMIT 20""")
def run_log(t):
    path = new_folder(t.spark, "runs")
    runs = t.events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("type"), F.col("user_id").alias("records"),
        F.col("value").alias("time"), "props")
    runlog.append_runs(runs, path)
    return rounded(runlog.read_runs(t.spark, path, 20))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
       " - 1 AS position FROM events")
def row_positions(t):
    return dense_position(t.events.select("event_id", "user_id", "ts"), ["ts", "event_id"],
                          ["user_id"]).drop("ts")


@query(f"""SELECT event_id, user_id,
       {r('avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 6)} AS mean_7,
       {r('avg(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 6)} AS mean_30
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rolling_means(t):
    placed = dense_position(t.events.select("event_id", "user_id", "ts", "value"),
                            ["ts", "event_id"], ["user_id"])
    means = rolling_mean(placed, F.col("value"), "position", {"mean_7": 7, "mean_30": 30}, ["user_id"])
    return rounded(means.select("event_id", "user_id", "mean_7", "mean_30"), 6)


@query(f"""SELECT event_id, user_id, {r('sum(value) OVER (PARTITION BY user_id '
       'ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 2)} AS total FROM events""")
def running_totals(t):
    placed = dense_position(t.events.select("event_id", "user_id", "ts", "value"),
                            ["ts", "event_id"], ["user_id"])
    return rounded(running_sum(placed, F.col("value"), "position", "total", ["user_id"]).select(
        "event_id", "user_id", "total"), 2)
