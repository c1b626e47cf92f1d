"""Notices that wait: when they are due, and what a stream tells and keeps."""

import datetime
import json

from pyspark.sql import functions as F

from noticelake.streaming import digests as D
from noticelake.streaming import ingest

SETTINGS = "email string, frequency string, quiet_start string, quiet_end string"


def at(text):
    return datetime.datetime.fromisoformat(text)


def test_minutes(spark):
    rows = spark.createDataFrame([("22:30",), ("7:05",), ("", ), (None,), ("x",), ("1:2",)], "c string")
    assert [r.m for r in rows.select(D.minute_of(F.col("c")).alias("m")).collect()] == [1350, 425, None, None, None, None]


def test_due(spark):
    cases = [
        ("2031-02-11T12:00:30", None, None, None, "2031-02-11T12:00:30"),
        ("2031-02-11T22:00:30", "x", 1320, 420, "2031-02-12T07:00:00"),  # wraps around midnight
        ("2031-02-11T06:59:59", "x", 1320, 420, "2031-02-11T07:00:00"),
        ("2031-02-11T07:00:00", "x", 1320, 420, "2031-02-11T07:00:00"),
        ("2031-02-11T13:00:00", "x", 720, 840, "2031-02-11T14:00:00"),
        ("2031-02-11T13:00:00", "x", 720, 720, "2031-02-11T13:00:00"),  # equal ends: none
        ("2031-02-11T13:00:00", "x", 720, None, "2031-02-11T13:00:00"),
        ("2031-02-11T13:00:00", "daily", None, None, "2031-02-12T00:00:00"),
        ("2031-02-28T23:59:59", "daily", 1320, 420, "2031-03-01T07:00:00"),
        ("2031-02-12T13:00:00", "weekly", 0, 480, "2031-02-17T08:00:00"),  # a Wednesday, told on Monday
        ("2031-02-17T00:00:00", "weekly", None, None, "2031-02-24T00:00:00"),
    ]
    rows = spark.createDataFrame([(i, at(c[0]), *c[1:4]) for i, c in enumerate(cases)], "i int, ts timestamp, f string, a int, b int")
    got = {r.i: r.due for r in rows.select("i", D.due(F.col("ts"), F.col("f"), F.col("a"), F.col("b")).cast("timestamp_ntz").alias("due")).collect()}
    assert got == {i: at(c[4]) for i, c in enumerate(cases)}


def test_a_stream_tells_what_is_due_and_keeps_the_rest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    settings = spark.createDataFrame([("d", "daily", None, None), ("q", "instant", "22:00", "07:00")], SETTINGS)

    def told(name, rows):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "email": e, "ts": t}) for i, e, t in rows), encoding="utf-8")
        stream = ingest.file_stream(spark, f"{tmp_path}/in", "id string, email string, ts timestamp", per_batch=1)
        D.send_waiting(stream, settings, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").select("user", F.col("due").cast("string").alias("due"), "n", "ids").collect()
        return sorted((r.user, r.due, r.n, r.ids) for r in rows)

    first = [("1", "d", "2031-02-11T10:00:00"), ("2", "d", "2031-02-11T11:00:00"), ("3", "q", "2031-02-11T10:30:00"), ("4", "q", "2031-02-11T22:30:00"), ("5", "no settings", "2031-02-11T12:00:00"), ("6", None, "2031-02-11T12:00:00"), ("7", "d", None)]
    now = [("no settings", "2031-02-11 12:00:00", 1, ["5"]), ("q", "2031-02-11 10:30:00", 1, ["3"])]
    assert told("1", first) == now  # digests and quiet hours wait
    second = [("8", "d", "2031-02-11T23:30:00"), ("9", "q", "2031-02-12T02:00:00")]
    daily = ("d", "2031-02-12 00:00:00", 3, ["1", "2", "8"])
    assert told("2", second) == sorted([*now, daily])  # over the restart
    third = [("10", "q", "2031-02-12T09:00:00"), ("11", "d", "2031-02-12T08:30:00")]
    later = [("q", "2031-02-12 07:00:00", 2, ["4", "9"]), ("q", "2031-02-12 09:00:00", 1, ["10"])]
    assert told("3", third) == sorted([*now, daily, *later])


def test_many_users_of_one_time_are_few_keys(spark, tmp_path):
    """A key for each user and time costs calls and a timer each, which grow with the users."""
    (tmp_path / "in").mkdir()
    rows = [{"id": None if u == 7 else str(i), "email": f"u{u}", "ts": f"2031-02-11T1{i}:00:00"} for u in range(300) for i in range(2)]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    settings = spark.createDataFrame([(f"u{u}", "daily", None, None) for u in range(300)], SETTINGS)

    def run():
        query = D.send_waiting(ingest.file_stream(spark, f"{tmp_path}/in", "id string, email string, ts timestamp"), settings, f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
        return query

    timers = max(int(s["customMetrics"]["numRegisteredTimers"]) for p in run().recentProgress for s in json.loads(p.json)["stateOperators"])
    assert 0 < timers <= D.PARTS
    (tmp_path / "in" / "2.json").write_text(json.dumps({"id": "x", "email": "other", "ts": "2031-02-12T02:00:00"}), encoding="utf-8")
    run()
    told = {r.user: (r.n, r.ids) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert told == {f"u{u}": (2, [None, None] if u == 7 else ["0", "1"]) for u in range(300)} | {"other": (1, ["x"])}
