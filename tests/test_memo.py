"""Answers that are kept: what is asked, how often, and what a second run asks."""

from noticelake.operators import memo
from noticelake.operators.memo import Memo, extract_once, geocode_once


def test_a_batch_run_again_asks_nothing(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def extractor(system, text):
        asked.add(1)
        if text == "bad":
            raise ValueError("no")
        return f'{{"said": "{system}{text}"}}'

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "bad"), (5, None)], "id long, text string")
    kept = Memo(spark, f"{tmp_path}/memo", memo.ANSWER)
    run = lambda batch=rows, system="s": {r.id: (r.raw_json, r.error) for r in extract_once(batch, extractor, system, "text", kept, "m").collect()}
    first = run()
    assert first[1] == first[2] == ('{"said": "sa"}', None) and first[4] == (None, "ValueError: no") and first[5] == (None, "ValueError: no text")
    assert asked.value == 3
    assert run() == first and asked.value == 4  # what failed is tried again
    good = rows.where("id < 4")
    assert run(good) == {k: first[k] for k in (1, 2, 3)} and asked.value == 4
    more = good.unionByName(spark.createDataFrame([(9, "c")], rows.schema))
    assert run(more)[9] == ('{"said": "sc"}', None) and asked.value == 5
    assert run(good, system="t")[1] == ('{"said": "ta"}', None) and asked.value == 7  # another prompt is another question
    assert run(rows.limit(0)) == {}


def test_addresses_are_looked_up_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def lookup(address):
        calls.add(1)
        return {"first street": (1.5, 2.5)}.get(address)

    rows = spark.createDataFrame([(1, "First Street"), (2, " first street "), (3, "nowhere"), (4, None), (5, "nowhere")], "id long, address string")
    for _ in range(2):
        kept = Memo(spark, f"{tmp_path}/places", memo.PLACE)
        got = {r.id: (r.address, r.lat, r.lng, r.error) for r in geocode_once(rows, lookup, kept, rate_per_s=50).collect()}
        assert got == {1: ("First Street", 1.5, 2.5, None), 2: (" first street ", 1.5, 2.5, None), 3: ("nowhere", None, None, None), 4: (None, None, None, None), 5: ("nowhere", None, None, None)}
        assert calls.value == 2  # misses are kept too
