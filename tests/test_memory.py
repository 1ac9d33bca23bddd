"""Keyed memory of streams against the batch operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarryline.operators import discover, ledger
from quarryline.streaming import memory

DAY = dt.date(2024, 1, 1)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def drain(stream, tmp_path, mode):
    """The rows that the next batches give."""
    name = f"m{len(list(tmp_path.iterdir()))}_{mode}"

    def keep(batch, number):
        batch.write.mode("append").parquet(str(tmp_path / name))

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return [(name, *row) for row in stream.sparkSession.read.parquet(str(tmp_path / name)).collect()]


def test_what_was_seen_agrees_with_the_anti_join(spark, tmp_path):
    schema = "seq long, url string, title string"
    batches = [[(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n")], [(5, "a", "again"), (6, "c", "w"), (7, None, "n"), (8, "c", "v")]]
    (tmp_path / "in").mkdir()
    stream = memory.unseen_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "url", "seq")
    found = []
    for rows in batches:
        put(spark, rows, schema, tmp_path / "in")
        found += [row[1] for row in drain(stream, tmp_path, "append")]
    assert sorted(found) == [1, 2, 4, 6, 7]
    old, new = (spark.createDataFrame(rows, schema) for rows in batches)
    assert {r.seq for r in ledger.unknown_only(new, old, "url").collect()} == {6, 7, 8}


def test_recurrence_agrees_with_the_batch_merge(spark, tmp_path):
    schema = "title string, why string, bucket string, seq long, day date"
    at = lambda n: DAY + dt.timedelta(days=n)
    batches = [
        [("Diver ", "far", None, 1, at(0)), ("diver", "no word of the field", None, 2, at(0)), ("Cook", None, "rule", 3, at(0)), ("", "x", None, 4, at(0))],
        [("DIVER", "late", None, 5, at(30)), ("Guard", "x", "no-field", 6, at(30))],
        [("Cook", "back", None, 7, at(80)), ("diver", "on", None, 8, at(80))],
    ]
    (tmp_path / "in").mkdir()
    stream = memory.recurrence_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    newest, held = {}, spark.createDataFrame([], memory.STORE)
    for rows in batches:
        put(spark, rows, schema, tmp_path / "in")
        for row in drain(stream, tmp_path, "update"):
            newest[row[1]] = row[1:]
        held = discover.merge_drops(held, spark.createDataFrame(rows, schema).drop("day"), F.lit(rows[0][4]))
        held = spark.createDataFrame(held.collect(), held.schema)
    batch = {r["key"]: tuple(r[c] for c in memory.STORE.replace(",", "").split()[::2]) for r in held.collect()}
    assert batch.keys() == {"diver", "guard", "cook"} and {k: newest[k] for k in batch} == batch
    assert newest["cook"][4] == 2 and newest["diver"][1] == "Diver " and newest["diver"][4] == 4


def test_what_is_not_met_is_forgotten(spark, tmp_path):
    schema = "title string, why string, bucket string, seq long, day date"
    (tmp_path / "in").mkdir()
    stream = memory.recurrence_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    newest = {}
    for seq, (title, day) in enumerate([("Cook", 0), ("Guard", 90), ("Guard", 91), ("Cook", 92)]):
        put(spark, [(title, "x", None, seq, DAY + dt.timedelta(days=day))], schema, tmp_path / "in")
        newest.update({row[1]: row[1:] for row in drain(stream, tmp_path, "update")})
    assert newest["cook"][4] == 1 and newest["guard"][4] == 2
