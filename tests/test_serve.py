import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from noticelake.operators import serve as S
from noticelake.operators import users as U
from noticelake.schemas import FLAT_EXTRACTION, OUTAGE, RUN_NOTICE, USER

OUTAGES = [(1, "d", "No water at Hill", ["Hill Park", "Lake"], None, None), (2, "d", "Works", ["lake side"], "10:00", None), (3, "d", None, None, None, None), (4, "d", "x", [""], None, None), (5, "d", "HILL works", [], None, None)]


def outages(spark):
    return spark.createDataFrame(OUTAGES, f"{RUN_NOTICE}, {FLAT_EXTRACTION}")


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_current_outages(spark):
    notices = outages(spark).select("id", "date", "message")
    parsed = spark.createDataFrame([(1, ["a"], "10:00", None), (1, ["a"], "10:00", None), (9, ["z"], None, None)], f"id long, {FLAT_EXTRACTION}")
    got = S.current_outages(notices, parsed)
    assert got.count() == 5 and [f"{c} {t}" for c, t in got.dtypes] == [x.replace("long", "bigint") for x in OUTAGE.split(", ")]
    row = S.by_id(got, 1).first()
    assert row.locations == ["a"] and row.lat is None and S.by_id(got, 77).collect() == []


@pytest.mark.parametrize(("query", "facet", "want"), [("", "all", [1, 2, 3, 4, 5]), ("hill", "all", [1, 5]), ("LAKE", "all", [1, 2]), ("", "Lake", [1]), ("", "lake", []), ("works", "lake side", [2]), ("zzz", "all", [])])
def test_search(spark, query, facet, want):
    assert ids(S.search(outages(spark), query, facet)) == want


def test_facets(spark):
    assert sorted(r.facet for r in S.facets(outages(spark), "locations").collect()) == ["", "Hill Park", "Lake", "lake side"]


def near_plain(location, district):
    a, b = location.lower(), district.lower()
    return b in a or a in b or any(len(w) > 3 and w in a for w in b.split(" "))


LOCATIONS = ["Hill Park", "lake", "", "a", "Parking lot", "Old Unknown District road", "ab", "Ла", "Гр. Лаке"]
DISTRICTS = ["Hill", "north lake side", "Unknown district", "ab", "x", "", "parking", "the old park", "лаке", "ПАРК a"]


def test_near_one_user(spark):
    for districts in (["hill"], ["Lake Side"], ["unknown lake"], []):
        want = [o[0] for o in OUTAGES if any(near_plain(loc, d) for loc in o[3] or [] for d in districts)]
        assert ids(S.near(outages(spark), districts)) == want


def test_pairs_by_equality_joins_lose_nothing(spark):
    locations = spark.createDataFrame([(x,) for x in LOCATIONS], "location string")
    districts = spark.createDataFrame([(x,) for x in DISTRICTS], "district string")
    got = S.contains_pairs(locations, districts)
    assert {(r.location, r.district) for r in got.collect()} == {(a, b) for a, b in itertools.product(LOCATIONS, DISTRICTS) if near_plain(a, b)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_users(spark):
    users = spark.createDataFrame([("u", "f", "l", [("s", "Hill"), ("s", "Lake")]), ("v", "f", "l", []), ("w", "f", "l", None), ("x", "f", "l", [("s", "Nowhere")])], USER)
    got = {(r.email, r.id) for r in S.near_users(outages(spark), users).collect()}
    assert got == {("u", 1), ("u", 2), ("u", 4), ("x", 4)}  # an empty location is near everyone


def test_facet_list_is_sorted_behind_the_entry_for_all(spark):
    got = sorted((r.place, r.facet) for r in S.facet_list(outages(spark), "locations").collect())
    assert got == [(0, "all"), (1, ""), (2, "Hill Park"), (3, "Lake"), (4, "lake side")]


def test_latest_and_status(spark):
    at = datetime.datetime
    rows = spark.createDataFrame([(1, at(2024, 1, 1, 5)), (2, at(2024, 1, 2, 1)), (3, at(2024, 1, 2, 2))], "id long, ts timestamp")
    assert ids(S.of_latest(rows, F.to_date("ts"))) == [2, 3]
    status = S.run_status(rows, "ts", F.to_date("ts"), "id").first()
    assert (status.total_runs, status.last_id) == (2, 3)
    assert S.run_status(rows.limit(0), "ts", F.to_date("ts"), "id").first().last_run is None


def table(spark):
    return spark.createDataFrame([("A@b.c", "a", "a", [("s1", "n1")]), ("d@e.f", "d", "d", []), ("g@h.i", "g", "g", None)], USER)


def emails(rows):
    return sorted(r.email for r in rows.collect())


def test_lookups(spark):
    users = table(spark)
    assert U.by_email(users, " a@B.c ").first().first_name == "a" and U.by_email(users, "a@b.c", exact=True).collect() == []
    assert U.exists(users, "D@E.F") and not U.exists(users, "zz")
    accounts = spark.createDataFrame([("u1", "a", "secret")], "user_id string, email string, password_hash string")
    assert U.by_user_id(accounts, "u1").columns == ["user_id", "email"]


def test_changes(spark):
    users = table(spark)
    new = spark.createDataFrame([("a@B.C", "new", "x", []), ("z@z.z", "z", "z", [])], USER)
    assert emails(U.upserted(users, new)) == ["a@B.C", "d@e.f", "g@h.i", "z@z.z"]
    assert emails(U.deleted(users, new)) == ["d@e.f", "g@h.i"]
    twice = spark.createDataFrame([("a@x.bg", "one", "x", []), ("A@x.bg ", "two", "x", []), ("a@X.bg", "zzz", "x", [])], USER).withColumn("at", F.expr("case first_name when 'two' then 9 else 1 end"))
    assert [r.first_name for r in U.upserted(users, twice, "at").where("email like '%x.bg%'").collect() + U.upserted(users, twice, "at").where("lower(email) like '%x.bg%'").collect()] in (["two"], ["two", "two"])
    assert U.upserted(users, twice.drop("at")).count() == 4 and U.registered(users, twice.drop("at"))[0].count() == 4
    added, refused = U.registered(users, new)
    assert emails(added) == ["A@b.c", "d@e.f", "g@h.i", "z@z.z"] and emails(refused) == ["a@B.C"]
    again = U.with_addresses(users, spark.createDataFrame([(" a@b.c", []), ("g@h.i", [("s", "n")])], "email string, addresses array<struct<street:string,neighborhood:string>>"))
    assert {r.email: r.addresses and len(r.addresses) for r in again.collect()} == {"A@b.c": [], "d@e.f": [], "g@h.i": 1}


def test_address_lists(spark):
    rows = table(spark)
    got = {r.email: r for r in rows.select("email", U.address_added("addresses", F.lit(" ул. Шипка 1 ")).alias("more"), U.address_added("addresses", F.lit(" ")).alias("same"), U.address_removed("addresses", 0).alias("less")).collect()}
    assert got["A@b.c"].more[-1].neighborhood == "Център" and got["A@b.c"].more[-1].street == "ул. Шипка 1" and len(got["A@b.c"].same) == 1 and got["A@b.c"].less == []


def test_every_registration_is_added_or_refused(spark):
    rows = lambda found: sorted(map(tuple, found.collect()), key=str)
    schema = "email string, at long"
    users = spark.createDataFrame([("a@x", 0), (None, 0)], schema)
    new = [("b@x", 2), ("B@x ", 1), ("A@X", 1), (None, 5), (None, 5), ("  ", 6), ("c@x", 1), ("c@x", 1), ("c@x", None)]
    table, refused = U.registered(users, spark.createDataFrame(new, schema), "at")
    assert rows(table) == rows(spark.createDataFrame([("a@x", 0), (None, 0), ("B@x ", 1), ("c@x", None)], schema))
    assert sorted(((r.email, r.at, r.reason) for r in refused.collect()), key=str) == sorted([("b@x", 2, "repeated"), ("A@X", 1, "exists"), (None, 5, "no address"), (None, 5, "no address"), ("  ", 6, "no address"), ("c@x", 1, "repeated"), ("c@x", 1, "repeated")], key=str)
    changed = U.upserted(users, spark.createDataFrame(new, schema), "at")
    assert rows(changed) == rows(spark.createDataFrame([(None, 0), ("A@X", 1), ("b@x", 2), ("c@x", 1)], schema))
    assert U.unapplied(spark.createDataFrame(new, schema), "at").count() == len(new) - 3
    assert U.registered(users, users.limit(0))[1].count() == 0
