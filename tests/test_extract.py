import json

import pytest
from pyspark.sql import functions as F

from noticelake.operators import addresses as A
from noticelake.operators import extract as E
from noticelake.schemas import FLAT_EXTRACTION, TRANSIT_EXTRACTION, WATER_EXTRACTION

TREE = {
    "locations": [
        {"location_name": "Town", "sublocations": [{"sublocation_name": "North", "streets": ["First", "Second"]}, {"sublocation_name": "South", "streets": []}, {"sublocation_name": None, "streets": ["Third"]}]},
        {"location_name": "Village", "sublocations": []}, {"location_name": "Hamlet"}, {"location_name": None, "sublocations": None},
    ],
    "start_time": "10:00", "end_time": None, "extra": 1,
}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, raw_json string")


def test_parse_unwrap_and_quarantine(spark):
    flat = {"locations": ["a"], "start_time": "10:00", "end_time": None}
    rows = frame(spark, [json.dumps(flat), json.dumps(json.dumps(flat)), '{"locations": ["a"', "", None, "[1]", "null", "{}"])
    good, bad = E.parsed(rows, FLAT_EXTRACTION)
    got = {r.i: r.parsed for r in good.collect()}
    assert got[0] == got[1] and got[0].locations == ["a"] and got[0].end_time is None and got[7].locations is None
    assert sorted(got) == [0, 1, 7] and sorted(r.i for r in bad.collect()) == [2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        E.parsed(rows, FLAT_EXTRACTION, strict=True)[0].collect()


def test_extract_keeps_errors_apart_and_filters_come_first(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None)], "i int, x string")

    def extractor(system, text):
        if text == "bad":
            raise ValueError("no")
        return json.dumps({"bus_lines": [system + text]})

    assert [r.error for r in E.extract(rows.where("i = 3"), extractor, "s:", "x", ["i"]).collect()] == ["ValueError: no text"]
    raw = E.extract(rows.where("i < 3"), extractor, "s:", "x", ["i"])
    got = {r.i: r for r in raw.collect()}
    assert json.loads(got[1].raw_json) == {"bus_lines": ["s:one"]} and got[2].error == "ValueError: no" and 3 not in got
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Filter")
    good, bad = E.parsed(raw, TRANSIT_EXTRACTION)
    assert good.first().parsed.bus_lines == ["s:one"] and bad.count() == 1


def test_transit_records(spark):
    rows = spark.createDataFrame([("1", "h", "b", "t", (["5"],)), ("2", "h", "b", "t", (None,))], "data_id string, header string, body string, info_time string, parsed struct<bus_lines:array<string>>")
    got = E.transit_records(rows).collect()
    assert {len(r.id) for r in got} == {36} and got[0].id != got[1].id and got[0].original_message.header == "h" and got[1].bus_lines is None


def test_flatten(spark):
    good, _ = E.parsed(frame(spark, [json.dumps(TREE), json.dumps({"locations": None}), json.dumps({"locations": []})]), WATER_EXTRACTION)
    rows = good.select("i", "parsed.locations")
    got = A.flattened(rows, keep=["i"])
    assert sorted(r.address for r in got.collect()) == ["", "First North Town", "Hamlet", "Second North Town", "South Town", "Third Town", "Village"]
    assert got.where("address = 'Hamlet'").first().full_address == f"Hamlet {A.CITY_SUFFIX}"
    assert A.collected(got, "i").first().addresses[-1] == "Village"


def test_geocode_looks_each_address_up_once(spark):
    addresses = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "address string")
    gazetteer = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0)], "address string, lat double, lng double")
    got = sorted((str(r.address), r.lat) for r in A.geocoded(addresses, gazetteer).collect())
    assert got == [("None", None), ("a", 1.0), ("a", 1.0), ("b", None)]


def test_rule_extractor():
    got = json.loads(E.rule_extractor("", 'Без вода в гр.Град, кв."Горен", ул. "Първа", бл. 7 от 10 ч.'))
    assert got["locations"][0] == {"location_name": "Град", "sublocations": [{"sublocation_name": "кв. Горен", "streets": ["бл. 7, Първа"]}]}
    assert (got["start_time"], got["end_time"], got["start_date"]) == ("10:00", None, None)
    assert json.loads(E.rule_extractor("", "Без вода"))["locations"][0]["location_name"] == E.DEFAULT_CITY
    got = json.loads(E.rule_extractor("", "в с.Село и с. Друго след 8.03.2031 от 9,15 ч. и може би до 21ч. на 12.04.2031, бул. Трети"))
    assert [x["location_name"] for x in got["locations"]] == ["Село", "Друго"] and got["locations"][0]["sublocations"][0]["streets"] == ["бул. Трети"]
    assert [got[k] for k in ("start_time", "end_time", "start_date", "end_date")] == ["09:15", "21:00", "8.03.2031", "12.04.2031"]


def test_flat_extraction(spark):
    row = spark.createDataFrame([('от 10.30ч. до 14ч. по ул. "Първа" в кв. Горен.',)], "m string").select(E.flat_extraction("m").alias("e")).first().e
    assert row.start_time == "10:30" and row.end_time == "14:00" and row.locations == ["Първа", "Горен"]


def test_usable_batches(spark):
    rows = frame(spark, ["[]", " [ ] ", "", "\n", '[{"id": 1}]', "[{", None]).withColumnRenamed("raw_json", "content")
    usable, empty, malformed = E.usable_batches(rows)
    ids = lambda d: sorted(r.i for r in d.collect())
    assert (ids(usable), ids(empty), ids(malformed)) == ([4], [0, 1, 2, 3, 6], [5])


def test_each_text_is_parsed_and_searched_once(spark):
    rows = spark.createDataFrame([(1, '{"k": 1, "s": {"t": [2]}}')], "i int, raw_json string")
    for half in E.parsed(rows, "k int, s struct<t: array<int>>"):
        plan = half.select("*")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 0 and plan.count("parse_json(raw_json") + plan.count("parseJson(raw_json") <= 1
    told = rows.select("i", E.flat_extraction("raw_json").alias("e")).select("i", "e.start_time", "e.end_time", F.col("e.locations")[0], F.col("e.locations")[1])
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3 and plan.count("regexp_replace(") == 1 and plan.count("regexp_extract(") == 2
