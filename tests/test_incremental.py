import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from noticelake.operators import incremental as I
from noticelake.sources.state import SeenIds, Watermark


def loop(ids, start, misses):
    """The scan as a plain loop."""
    found, missed, at = [], 0, start
    while missed < misses and at <= max([*ids, start]) + misses:
        if at in ids:
            found.append(at)
            missed = 0
        else:
            missed += 1
        at += 1
    return found


@pytest.mark.parametrize("misses", [1, 3])
def test_until_misses_against_a_loop(spark, misses):
    rng = random.Random(misses)
    for ids in [{1, 2, 3}, {1, 2, 5}, {1, 2, 6}, {4, 5}, set(), {5}, *({rng.randrange(1, 40) for _ in range(n)} for n in (10, 25, 35))]:
        hits = spark.createDataFrame([(i,) for i in [*ids, *ids]], "id long")
        got = I.until_misses(hits.dropDuplicates(), 1, misses)
        assert sorted(r.id for r in got.collect()) == loop(ids, 1, misses)
        assert I.last_valid(hits, 1, misses).first().last_id == max(loop(ids, 1, misses), default=None)
        if ids:
            assert sorted({r.id for r in I.until_misses(hits, None, misses).collect()}) == loop(ids, min(ids), misses)


def test_no_window_over_all_ids(spark):
    plan = I.until_misses(spark.range(100))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" in plan  # the minimum alone


def test_watermark_filter_and_advance(spark):
    rows = spark.createDataFrame([(5,), (7,), (None,), (9,)], "id long")
    assert [r.id for r in I.above_watermark(rows, "id", 6).collect()] == [7, 9]
    assert I.advanced(rows, "id", 6).first().last_id == 9 and I.advanced(rows, "id", 60).first().last_id == 60 and I.advanced(rows.limit(0), "id", 6).first().last_id == 6
    assert I.next_id(spark.createDataFrame([], "last_id long")).first().next_id == 16_000
    assert I.next_id(spark.createDataFrame([(4,)], "last_id long")).first().next_id == 5


def test_unseen(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "data_id string, n int")
    seen = spark.createDataFrame([("a",), ("a",), (None,)], "data_id string")
    fresh = I.unseen(rows, seen, "data_id")
    assert sorted(r.n for r in fresh.collect()) == [2, 3, 4]
    assert len(I.unseen(rows, seen, "data_id", dedup=True).collect()) == 2
    assert I.unseen(rows.where("data_id is not null"), I.appended(seen, fresh.select("data_id")), "data_id").collect() == []
    assert "LeftAnti" in fresh._jdf.queryExecution().executedPlan().toString()


def test_fallback_ids_differ(spark):
    rows = spark.createDataFrame([("No ID", "h", "b"), ("No ID", "h", "c"), ("7", "h", "b"), (None, "h", "b")], "data_id string, header string, body string")
    got = [r.data_id for r in I.with_fallback_id(rows, "data_id", "No ID", ["header", "body"]).collect()]
    assert got[2] == "7" and got[0] == got[3] != got[1] and len(got[0]) == 64


def test_valid(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", "")], "d string, m string")
    assert [r.v for r in rows.select(I.is_valid("d", "m").alias("v")).collect()] == [True, False, False, False]


def test_matching(spark):
    assert I.matching(spark.createDataFrame([("a1",), ("b",), (None,)], "x string"), "x", "[0-9]").count() == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.lists(st.integers(0, 100), min_size=1, max_size=5))
def test_watermark_never_falls(spark, tmp_path_factory, ids):
    mark = Watermark(spark, str(tmp_path_factory.mktemp("mark")), default=10)
    assert mark.get() == 10
    for k, i in enumerate(ids):
        before = mark.get()
        assert mark.advance(i, k) == max(before, i) == mark.get()
    assert len(mark.folder.versions()) <= 2


def test_seen_ids_versions(spark, tmp_path):
    seen = SeenIds(spark, f"{tmp_path}/seen")
    assert seen.get().collect() == []
    for batch, ids in enumerate((["a", "b"], ["b", "c"], ["d"])):
        seen.add(spark.createDataFrame([(i,) for i in ids], "data_id string"), batch)
    everything = lambda s: sorted(r.data_id for r in s.collect())
    assert everything(seen.get()) == ["a", "b", "c", "d"] and everything(seen.get(before_batch=1)) == ["a", "b"]
    seen.add(spark.createDataFrame([("e",)], "data_id string"), 2)  # the same batch again replaces
    assert everything(seen.get()) == ["a", "b", "c", "e"]
    seen.compact()
    assert everything(seen.get()) == ["a", "b", "c", "e"] and seen.folder.versions() == [1, 2]
    assert everything(seen.get(before_batch=1)) == ["a", "b"]  # what that batch met at first, compacted or not


def test_seen_ids_are_compacted_by_number_of_versions(spark, tmp_path):
    seen = SeenIds(spark, f"{tmp_path}/seen", most_versions=3)
    for batch in range(8):
        seen.add(spark.createDataFrame([(str(batch),)], "data_id string"), batch)
        assert len(seen.folder.versions()) <= 3
    assert sorted(r.data_id for r in seen.get().collect()) == [str(b) for b in range(8)]


@pytest.mark.parametrize("broken", ["rename", "delete"])
def test_state_survives_a_failure_between_steps(spark, tmp_path, broken):
    mark = Watermark(spark, str(tmp_path), default=16_000)
    mark.advance(20_000, 1)

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == broken:
                raise OSError("lost")
            return getattr(self.fs, name)

    whole = mark.folder._fs
    mark.folder._fs = Broken(whole)
    with pytest.raises(OSError, match="lost"):
        mark.advance(30_000, 1)
    mark.folder._fs = whole
    assert mark.get() == Watermark(spark, str(tmp_path), default=16_000).get() == (20_000 if broken == "rename" else 30_000)
    assert mark.advance(25_000, 2) == max(25_000, mark.get()) and Watermark(spark, str(tmp_path)).get() == mark.get()
