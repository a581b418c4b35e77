import json

from pyspark.sql import functions as F

from quiltframe.operators.scratch import scratch_folder, store
from quiltframe.sources import files, runlog
from quiltframe.streaming.rowwise import clean_stream


def test_csv_types_are_inferred(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "n int, s string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert dict(back.dtypes) == {"n": "int", "s": "string", "x": "double"}
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_one_csv_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("n,s\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        table = files.read_csv(spark, str(path))
        whole = files.read_csv(spark, str(path), multi_line=True)
        assert table.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        for df in (table, whole):
            assert df.selectExpr("count(*)", "sum(n)", "count_if(s = concat('x, \"', n, '\"'))").first() == (
                60_000, 60_000 * 59_999 // 2, 60_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rows_per_file(spark, tmp_path):
    files.write_csv(spark.range(100).selectExpr("id", "concat('a\n', id) AS s").coalesce(1), str(tmp_path / "c"), rows_per_file=30)
    assert len(list((tmp_path / "c").glob("part-*"))) == 4
    back = files.read_csv(spark, str(tmp_path / "c"), "id long, s string", multi_line=True)
    assert back.where("s = concat('a\n', id)").count() == 100


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": None}, {"a": 2, "b": "x"}], indent=2))
    array = files.read_json(spark, str(tmp_path / "a.json"), array=True)
    files.write_json(array, str(tmp_path / "lines"))
    assert sorted(map(str, files.read_json(spark, str(tmp_path / "lines")).collect())) == sorted(
        map(str, array.collect()))


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(4):
        runlog.append_run(spark, path, {"type": f"t{i}", "records": i, "metadata": {"user": "me"}})
    runlog.append_run(spark, path, {})
    rows = runlog.read_runs(spark, path, 3).collect()
    assert [r["data_type"] for r in rows] == ["Unknown", "t3", "t2"] and rows[0]["records"] == 0
    assert spark.read.parquet(path).where("data_type = 't1'").first()["metadata"] == '{"user":"me"}'


def test_scratch_folder_is_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or scratch_folder(spark) == configured
    assert store(spark.range(3), "t").count() == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(" a@b.org ", "2024-01-01"), ("  ", "x")], "mail string, day_date string") \
        .write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mail string, day_date string").parquet(str(tmp_path / "in"))
    run = clean_stream(stream, {"mail": ["email"]}).writeStream.format("memory").queryName("cleaned") \
        .trigger(availableNow=True).start()
    run.awaitTermination(60)
    rows = {tuple(r) for r in spark.table("cleaned").select("mail", F.col("day_date").cast("string")).collect()}
    assert rows == {("a***@b.org", "2024-01-01 00:00:00"), (None, None)}
