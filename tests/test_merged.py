"""A table of users that is merged when it is read, against a dict."""

import random

import pytest

from noticelake.sources import merged
from noticelake.sources.commits import CommitConflict
from noticelake.sources.merged import MergedUsers

SCHEMA = "email string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def users(table):
    return sorted((r.email, r.n) for r in table.read().collect())


def files(tmp_path):
    return {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}


def test_an_upsert_of_ten_rows_rewrites_no_file(spark, tmp_path):
    table = MergedUsers(spark, f"{tmp_path}/t", SCHEMA, buckets=4)
    refused = table.create(frame(spark, [(f"U{k}@x", k) for k in range(1000)] + [("u1@X ", 0), (None, 1)]))
    assert sorted((str(r.email), r.reason) for r in refused.collect()) == [("None", "no address"), ("U1@x", "superseded")]
    before, base = files(tmp_path), table.log.snapshot().of(merged.BASE)
    refused = table.upsert(frame(spark, [(f" u{k}@X", -k) for k in range(10, 20)] + [(None, 5), ("u10@x", -99)]))
    assert sorted((str(r.email), r.n, r.reason) for r in refused.collect()) == [(" u10@X", -10, "superseded"), ("None", 5, "no address")] or refused.count() == 2
    after = files(tmp_path)
    assert all(after[p] == t for p, t in before.items()) and table.log.snapshot().of(merged.BASE) == base
    assert 1 <= len(after) - len(before) <= 4
    found = dict(users(table))
    assert len(found) == 1000 and found[" u11@X"] == -11 and found["U20@x"] == 20


def test_against_a_dict(spark, tmp_path):
    rng = random.Random(5)
    table, want = MergedUsers(spark, f"{tmp_path}/t", SCHEMA, buckets=3, most_deltas=2, share=9), {}
    table.create(frame(spark, []))
    for step in range(7):
        keys = rng.sample(range(12), 4)
        rows = [(rng.choice(["a{}@x", "A{}@X", " a{}@x"]).format(k), 100 * step + k) for k in keys]
        kind = ("upsert", "register", "delete")[step % 3]
        if kind == "upsert":
            assert table.upsert(frame(spark, rows)).count() == 0
            want |= {r[0].strip().lower(): r for r in rows}
        elif kind == "register":
            refused = {(r.email, r.reason) for r in table.register(frame(spark, [*rows, rows[0]])).collect()}
            taken = {r[0] for r in rows if r[0].strip().lower() in want}
            assert {e for e, why in refused if why == "exists"} == taken and len(refused) == len(taken | {rows[0][0]})
            want |= {r[0].strip().lower(): r for r in rows if r[0] not in taken}
        else:
            table.delete(frame(spark, rows))
            want = {k: v for k, v in want.items() if k not in {r[0].strip().lower() for r in rows}}
        assert users(table) == sorted(want.values())
        if step == 4:
            assert table.settle() and not table.settle() and users(table) == sorted(want.values())
            assert [e.key for e in table.log.snapshot().entries] == [merged.BASE]
    for k in range(12):
        assert [tuple(r) for r in table.lookup(f"A{k}@x ").collect()] == ([want[f"a{k}@x"]] if f"a{k}@x" in want else [])
    assert table.lookup("nobody").collect() == []


def test_a_look_up_reads_one_bucket(spark, tmp_path):
    table = MergedUsers(spark, f"{tmp_path}/t", SCHEMA, buckets=8)
    table.create(frame(spark, [(f"u{k}@x", k) for k in range(200)]))
    rows = table.lookup("U7@x")
    assert rows.first().n == 7
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan and len({r[0] for r in rows.selectExpr("input_file_name()").collect()}) == 1


def test_concurrent_writers(spark, tmp_path):
    table = MergedUsers(spark, f"{tmp_path}/t", SCHEMA, buckets=2)
    table.create(frame(spark, [("a@x", 1)]))
    other = MergedUsers(spark, f"{tmp_path}/t", SCHEMA, buckets=2)
    with pytest.raises(CommitConflict, match="already"):
        other.create(frame(spark, []))
    commit, once = table.log.commit, []

    def late(change, attempts=20):
        """Just before this writer commits, the other one registers the same address."""
        if not once:
            once.append(other.register(frame(spark, [("b@x", 9)])).count())
        return commit(change, attempts)

    table.log.commit = late
    refused = table.register(frame(spark, [("B@x", 2), ("c@x", 3)]))
    assert [(r.email, r.reason) for r in refused.collect()] == [("B@x", "exists")] and users(table) == [("a@x", 1), ("b@x", 9), ("c@x", 3)]
    once.clear()
    table.log.commit = lambda change, attempts=20: (once or once.append(other.upsert(frame(spark, [("a@x", 7)]))), commit(change, attempts))[1]
    assert table.settle(force=True)  # a change that comes while the base is made stays
    assert users(table) == [("a@x", 7), ("b@x", 9), ("c@x", 3)]
