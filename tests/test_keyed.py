"""Keyed state: what is new, again after a restart, and what a batch reads."""

import json

from noticelake.streaming import ingest, keyed


def put(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("data_id", "n"), r, strict=True))) for r in rows), encoding="utf-8")


def streamed(spark, tmp_path, checkpoint="check", **options):
    stream = ingest.file_stream(spark, f"{tmp_path}/in", "data_id string, n int", per_batch=1)
    query = keyed.ingest_unseen_keyed(stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", **options)
    query.awaitTermination()
    return query, sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_rows_of_ids_that_were_not_seen(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = spark.createDataFrame([("z",), ("z",), (None,)], "data_id string")
    put(tmp_path / "in", "1", [("a", 1), ("a", 2), (None, 3), (None, 3)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert streamed(spark, tmp_path, seen=seen)[1] == [1, 2, 3, 3]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    put(tmp_path / "in", "2", [("a", 4), ("b", 5), ("z", 6), (None, 7)])
    assert streamed(spark, tmp_path, seen=seen)[1] == [1, 2, 3, 3, 5, 7]
    assert streamed(spark, tmp_path, seen=seen)[1] == [1, 2, 3, 3, 5, 7]  # nothing new


def test_one_row_an_id(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "1", [("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)])
    assert streamed(spark, tmp_path, dedup=True)[1] == [1, 2, 3, 3]


def test_a_batch_reads_no_more_when_much_was_seen(spark, tmp_path):
    """Batches of three ids each after a large and after a small first one: the state grows, what a batch loads and reads does not."""
    told = {}
    for name, size in (("small", 10), ("large", 4_000)):
        top = tmp_path / name
        (top / "in").mkdir(parents=True)
        put(top / "in", "1", [(f"{k}", k) for k in range(size)])
        streamed(spark, top)
        for batch in range(2):
            put(top / "in", f"2{batch}", [(f"new{batch}-{k}", k) for k in range(3)])
            query, _ = streamed(spark, top)
        plan = query.lastProgress["stateOperators"][0]
        told[name] = (plan["numRowsTotal"], plan["customMetrics"]["rocksdbGetCount"], plan["customMetrics"]["rocksdbTotalBytesRead"], query.lastProgress["numInputRows"])
    assert told["small"][0] == 16 and told["large"][0] == 4_006
    assert told["small"][1:] == told["large"][1:], told
