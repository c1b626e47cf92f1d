"""The streaming source of pages by id: batches, restarts, and polling."""

import time

from noticelake.sources.idstream import _ranges, id_stream
from noticelake.streaming import ingest


def test_ranges():
    for first, end, parts in ((1, 11, 4), (5, 5, 3), (1, 3, 8), (0, 100, 1)):
        got = [i for r in _ranges(first, end, parts) for i in range(r.first, r.end)]
        assert got == list(range(first, end)) and len(_ranges(first, end, parts)) <= parts


def test_batches_and_restart(spark, tmp_path):
    """Each id is asked for once, whatever fails; a second start goes on behind the last id."""
    folder = tmp_path / "asked"
    folder.mkdir()
    place, newest = str(folder), [7]

    def fetch(url):
        import uuid

        open(f"{place}/{url.strip('/')}.{uuid.uuid4().hex}", "w").close()
        if url == "/5.html":
            raise OSError("down")
        return f"<p>{url}</p>"

    def run():
        stream = id_stream(spark, lambda: newest[0], fetch, "/", above=2, parts=3, name="pages_restart")
        query = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id={n}")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.id: (r.html, r.error) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    first = run()
    assert sorted(first) == [3, 4, 5, 6, 7] and first[5] == (None, "OSError: down") and first[3] == ("<p>/3.html</p>", None)
    newest[0] = 10
    assert sorted(run()) == list(range(3, 11)) and sorted(run()) == list(range(3, 11))
    newest[0] = 4  # a listing that shrinks
    assert sorted(run()) == list(range(3, 11))
    assert sorted(f.name.split(".")[0] for f in folder.iterdir()) == sorted(map(str, range(3, 11)))


def test_polling(spark, tmp_path):
    """The trigger polls the source again and again; rows above the mark arrive as the listing grows."""
    listing = tmp_path / "newest"
    listing.write_text("3")
    place = str(listing)
    stream = id_stream(spark, lambda: int(open(place).read()), lambda url: "x", "/", above=0, name="pages_polled").select("id", "html")
    query = ingest.ingest_above(stream, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/check", poll="500 milliseconds")

    def until(ids):
        for _ in range(120):
            query.exception()
            if (tmp_path / "out").exists() and list((tmp_path / "out").rglob("_SUCCESS")):
                got = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
                if got == ids:
                    return True
            time.sleep(0.5)
        return False

    try:
        assert until([1, 2, 3])
        listing.write_text("5")
        assert until([1, 2, 3, 4, 5])
    finally:
        query.stop()
