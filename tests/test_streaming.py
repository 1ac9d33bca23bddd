from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarryline.operators import mail
from quarryline.streaming import twins

DAY = dt.datetime(2024, 1, 1)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_ghosted_stream_agrees_with_batch(spark, tmp_path):
    schema = "app_id long, kind string, at timestamp"
    at = lambda d: DAY + dt.timedelta(days=d)
    write(spark, [(1, "acknowledged", at(0)), (2, "acknowledged", at(0)), (2, "interview", at(3)), (3, "acknowledged", at(50)), (4, "rejected", at(1))], schema, tmp_path / "in")
    stream = twins.ghosted_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    start = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    start().awaitTermination()
    write(spark, [(9, "acknowledged", at(80))], schema, tmp_path / "in")
    start().awaitTermination()
    write(spark, [(9, "acknowledged", at(81))], schema, tmp_path / "in")
    start().awaitTermination()
    found = {r.app_id: r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: "ghosted", 2: "interview", 4: "rejected"}
    apps = spark.createDataFrame([(i, at(0), False) for i in (1, 2, 3, 4)], "id long, ts timestamp, longshot boolean")
    batch = mail.application_states(apps, spark.read.parquet(str(tmp_path / "in")), F.lit(at(80)).cast("timestamp"))
    assert {r.id: r.state for r in batch.collect()} == {1: "ghosted", 2: "interview", 3: "acknowledged", 4: "rejected"}


def test_decisions_are_written_once(spark, tmp_path):
    schema = "update_id long, ts timestamp, text string"
    write(spark, [(1, DAY, "seen 3"), (1, DAY, "seen 3"), (2, DAY, "no 4 far")], schema, tmp_path / "in")
    for _ in range(2):
        updates = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        twins.decisions_once(updates, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        write(spark, [(1, DAY, "seen 3")], schema, tmp_path / "in")
    rows = sorted((r.update_id, r.command, r.ids, r.note) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(1, "seen", [3], ""), (2, "reject", [4], "far")]


def test_replies_join_within_the_interval(spark, tmp_path):
    write(spark, [(1, DAY)], "app_id long, ts timestamp", tmp_path / "a")
    write(spark, [(1, "x", DAY - dt.timedelta(days=2)), (1, "y", DAY - dt.timedelta(days=3)), (1, "z", DAY + dt.timedelta(days=29))], "app_id long, kind string, at timestamp", tmp_path / "r")
    joined = twins.replies_within(spark.readStream.schema("app_id long, ts timestamp").parquet(str(tmp_path / "a")), spark.readStream.schema("app_id long, kind string, at timestamp").parquet(str(tmp_path / "r")), watermark="60 days")
    joined.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["x", "z"]


def test_gates(spark):
    hour = 3_600_000
    wanted = spark.createDataFrame([("a", i, h * hour if h is not None else None) for i, h in enumerate((0, 1, 5, None, 6, 2, 3))], "k string, i long, at long")
    ran = twins.cadence_runs(wanted, "k", ("i",), "at", 4 * hour).filter("ran").orderBy("i").collect()
    assert [r.at for r in ran] == [0, 5 * hour, 2 * hour]
    cases = spark.createDataFrame([(100, None, True), (100, 90, False), (100, 10, True), (100, 200, True)], "now long, refused long, ok boolean")
    assert cases.filter(twins.cooled_down(F.col("now"), F.col("refused"), 50) != F.col("ok")).count() == 0
