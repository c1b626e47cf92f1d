import json
import os

import pytest

from noticelake.operators import extract as E
from noticelake.plans import flows
from noticelake.sources import pages, runs
from noticelake.streaming import ingest
from tests.test_html import ACCORDION, DETAIL

LIST = '<div id="main_content">' + "".join(f'<div class="list-item"><a href="{u}">x</a></div>' for u in ("/1.html", "/2.html", "/3.html", "/4.html", "/about", "/5.html")) + "</div>"


def fetcher():
    answers = {"/2.html": DETAIL, "/4.html": "<div id='main_content'><h1>t</h1></div>", "/5.html": DETAIL.replace("first", "bad")}
    return lambda url: answers[url]  # not a module's function: tasks cannot import tests


def test_listing_failure(spark):
    def fail(url):
        raise OSError("down")

    with pytest.raises(pages.SourceUnavailable):
        pages.read_listing(spark, "u", fail)
    assert pages.read_listing(spark, "u", fail, fail_on_error=False).first().error == "OSError: down"
    assert pages.read_listing(spark, "u", lambda _: "x").first().html == "x"


def test_water_flow(spark):
    def extractor(system, text):
        if "bad" in text:
            return "{"
        return json.dumps({"locations": [{"location_name": "Town", "sublocations": [{"sublocation_name": "N", "streets": ["S"]}]}], "start_time": "10:00"})

    listing = pages.read_listing(spark, "u", lambda _: LIST)
    gazetteer = spark.createDataFrame([("S N Town", 1.5, 2.5)], "address string, lat double, lng double")
    got = flows.water(listing, 1, fetcher(), extractor, gazetteer=gazetteer)
    row = got.records.collect()
    assert [(r.message_id, r.address, r.start_time, r.lat) for r in row] == [(2, "S N Town", "10:00", 1.5)]
    assert sorted((r.message_id, r.error) for r in got.quarantined.collect()) == [(3, "KeyError: '/3.html'"), (4, "no content"), (5, "malformed JSON")]
    assert got.state.first().last_id == 5
    assert flows.water(listing, 5, fetcher(), extractor).records.collect() == []
    strict = flows.water(listing, 1, fetcher(), extractor, strict_reference=True)
    assert strict.records.count() == 1 and [r.message_id for r in strict.quarantined.collect()] == [5]  # what failed to load is lost
    again = flows.retried(got.quarantined, lambda url: DETAIL if url == "/3.html" else "", extractor)
    assert [r.message_id for r in again.records.collect()] == [3] and sorted((r.message_id, r.error) for r in again.quarantined.collect()) == [(4, "no content"), (5, "no content")]


def test_pages_are_fetched_and_texts_asked_once(spark, tmp_path):
    fetched, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def fetch(url):
        fetched.add(1)
        if url == "/3.html":
            raise OSError("down")
        return DETAIL

    def extractor(system, text):
        asked.add(1)
        return json.dumps({"locations": [{"location_name": text}]})

    listing = pages.read_listing(spark, "u", lambda _: LIST.replace("/4.html", "/2.html"))
    got = flows.water(listing, 1, fetch, extractor)
    for _ in range(2):
        assert got.records.count() == 2 and got.quarantined.count() == 1 and got.state.first().last_id == 5
    assert fetched.value == 3 and asked.value == 2  # a repeated link is one page


def test_a_page_without_a_title_keeps_its_content(spark):
    page = DETAIL.replace("<h1>", "<h2>").replace("</h1>", "</h2>")
    listing = pages.read_listing(spark, "u", lambda _: LIST)
    told = flows.water(listing, 4, lambda _: page, lambda s, t: json.dumps({"locations": [{"location_name": t}]})).records.collect()
    assert len(told) == 1 and "first" in told[0].address and told[0].address != "Варна"
    assert flows.water(listing, 4, lambda _: page, lambda s, t: "{}", strict_reference=True).records.collect() == []


def test_transit_flow(spark):
    page = spark.createDataFrame([("u", ACCORDION, None)], "url string, html string, error string")
    seen = spark.createDataFrame([("7",)], "data_id string")
    first = flows.transit(page, seen.limit(0))
    assert first.records.count() == 2
    asked = flows.transit(page, seen, lambda s, t: json.dumps({"bus_lines": [t]}), hash_missing_ids=False)
    rows = asked.records.collect()
    assert [r.bus_lines for r in rows] == [["No header\nNo body"]] and asked.state.first().data_id == "No ID"
    assert flows.transit(page, seen, lambda s, t: "nonsense").quarantined.count() == 1


def write(path, text, age):
    path.write_text(text, encoding="utf-8")
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


def test_runs(spark, tmp_path):
    folder = str(tmp_path)
    assert runs.latest_path(runs.run_list(spark, folder)) is None and runs.latest_run(spark, folder).collect() == []
    assert runs.recorded(spark, f"{folder}/none").count() == 0
    write(tmp_path / "a.json", json.dumps([{"id": 1, "date": "d", "message": "old"}, {"id": 2, "date": "d", "message": "Б"}]), 30)
    write(tmp_path / "b.json", json.dumps([{"id": 1, "date": "d", "message": "new"}]), 20)
    write(tmp_path / "processed_c.json", "[]", 25)
    assert [r.message for r in runs.latest_run(spark, folder).collect()] == ["new"]
    assert {r.id: r.message for r in runs.latest_by_id(spark, folder).collect()} == {1: "new", 2: "Б"}
    write(tmp_path / "d.json", "[]", 10)
    assert runs.latest_run(spark, folder).collect() == [] and runs.latest_by_id(spark, folder).count() == 2
    assert sorted(r.name for r in runs.pending(spark, folder).collect()) == ["a.json", "b.json", "d.json"]
    write(tmp_path / "f.json", "", 8)  # no bytes at all
    assert runs.latest_path(runs.run_list(spark, folder)).endswith("f.json") and runs.latest_run(spark, folder).collect() == []
    assert [r.message for r in runs.latest_with_rows(spark, folder).collect()] == ["new"]
    assert runs.status(spark, folder).first().total_runs == 5
    usable, empty, malformed = E.usable_batches(runs.contents(spark, folder))
    assert sorted(r.name for r in empty.collect()) == ["d.json", "f.json"] and usable.count() == 2 and malformed.count() == 0
    write(tmp_path / "e.json", "[{", 5)
    assert runs.read_run(spark, f"{folder}/e.json").first()._corrupt_record is not None


def test_results_and_runs_are_written(spark, tmp_path):
    write(tmp_path / "result_7.json", '{"locations": []}', 1)
    write(tmp_path / "result_x.json", "{}", 1)
    got = runs.read_results(spark, str(tmp_path)).collect()
    assert [(r.id, r.raw_json) for r in got] == [(7, '{"locations": []}')]
    rows, folder, now = spark.createDataFrame([(1, "d", "m")], runs.RUN_NOTICE), f"{tmp_path}/runs", 1_700_000_000_000
    for _ in range(2):
        runs.write_run(rows, folder, "r1", now - 200_000)
    assert [r.message for r in runs.latest_run(spark, folder).collect()] == ["m"]
    many = spark.range(12).selectExpr("id", "'d' as date", "concat('m', id) as message").repartition(3)
    runs.write_run(many, folder, "r2", now - 100_000)
    write(tmp_path / "runs" / "old.json", json.dumps([{"id": 1, "date": "d", "message": "older"}, {"id": 77, "date": "d", "message": "kept"}], indent=1), 300)
    assert sorted(r.message for r in runs.latest_run(spark, folder).collect()) == sorted(f"m{i}" for i in range(12))
    latest = {r.id: r.message for r in runs.latest_by_id(spark, folder).collect()}
    assert latest == {**{i: f"m{i}" for i in range(12)}, 77: "kept"}
    status = runs.status(spark, folder).first()
    assert (status.total_runs, status.last_id) == (3, 77)
    assert {r.n_files for r in runs.recorded(spark, folder).where("run = 'r2'").collect()} == {3}
    runs.write_run(many.limit(0), folder, "r3")
    assert runs.latest_run(spark, folder).collect() == [] and runs.status(spark, folder).first().total_runs == 4
    assert runs.latest_with_rows(spark, folder).count() == 12
    runs.write_results(spark.createDataFrame([(1, "{}", "m", "h")], "id long, raw_json string, model string, prompt_hash string"), f"{tmp_path}/results")
    assert spark.read.parquet(f"{tmp_path}/results").first().model == "m"


def test_a_run_that_was_not_finished_is_none(spark, tmp_path):
    """A writer dies while it writes: its files lie there, and every reader has the run before."""
    folder = f"{tmp_path}/runs"
    rows = spark.range(4).selectExpr("id", "'d' as date", "concat('m', id) as message")
    runs.write_run(rows, folder, "r1")
    broken = rows.repartition(2).selectExpr("id", "date", "case when id = 3 then raise_error('killed') else message end as message")
    for run_id in ("r2", "r1"):  # a new run, and one that would have replaced r1
        with pytest.raises(Exception, match="killed"):
            runs.write_run(broken, folder, run_id)
        assert runs.latest_run(spark, folder).count() == 4 and runs.recorded(spark, folder).count() == 1
    log = runs._log(spark, folder)
    log.written(rows, "r3")  # whole, and never committed
    assert runs.recorded(spark, folder).count() == 1
    assert log.vacuum(older_than_s=-60) >= 1 and runs.latest_run(spark, folder).count() == 4


def test_stream_of_unseen_ids(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run(checkpoint="check"):
        stream = ingest.file_stream(spark, str(source), "data_id string, n int", per_batch=1)
        query = ingest.ingest_unseen(stream, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}")
        query.awaitTermination()
        return sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write(source / "1.json", '{"data_id": "a", "n": 1}\n{"data_id": "a", "n": 2}', 30)
    write(source / "2.json", '{"data_id": "a", "n": 3}\n{"data_id": "b", "n": 4}', 20)
    assert run() == [1, 2, 4]
    assert run() == [1, 2, 4]  # nothing new
    write(source / "3.json", '{"data_id": "b", "n": 5}\n{"data_id": "c", "n": 6}', 10)
    assert run() == [1, 2, 4, 6]
    assert run("lost-checkpoint") == [1, 2, 4, 6]  # all batches again, same result


def test_stream_above_the_mark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run(checkpoint="check"):
        stream = ingest.file_stream(spark, str(source), "id long", per_batch=1)
        ingest.ingest_above(stream, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", default=5).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write(source / "1.json", '{"id": 5}\n{"id": 9}\n{"id": 7}', 30)
    write(source / "2.json", '{"id": 8}\n{"id": 10}', 20)
    assert run() == [7, 9, 10]  # 8 is late
    write(source / "3.json", '{"id": 11}', 10)
    assert run() == [7, 9, 10, 11] and run() == [7, 9, 10, 11]


def test_digests_and_quiet_hours(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "1.json", '{"ts": "2024-01-01T05:00:00"}\n{"ts": "2024-01-01T23:00:00"}\n{"ts": "2024-01-09T01:00:00"}', 30)
    query = ingest.digests(ingest.file_stream(spark, str(source), "ts timestamp")).writeStream.format("memory").queryName("digests").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("digests").collect()) == [1, 2]
    rows = spark.createDataFrame([(m, a, b) for m in (0, 419, 420, 1320, 1319) for a, b in ((1320, 420), (60, 120))], "m int, a int, b int")
    got = {(r.m, r.a): r.q for r in rows.select("m", "a", ingest.is_quiet("m", "a", "b").alias("q")).collect()}
    assert [got[m, 1320] for m in (0, 419, 420, 1320, 1319)] == [True, True, False, True, False] and not any(got[m, 60] for m in (0, 419, 1320))
