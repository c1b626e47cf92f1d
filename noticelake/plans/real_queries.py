"""Queries that take whole operators and flows through the test tables: pages are made of their columns, state and runs are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.functions import html as H
from noticelake.functions import text as T
from noticelake.operators import addresses as A
from noticelake.operators import extract as E
from noticelake.operators import incremental as I
from noticelake.operators import memo
from noticelake.operators import serve as S
from noticelake.operators import textsearch
from noticelake.operators import users as U
from noticelake.plans import api, flows
from noticelake.plans.queries import query, table
from noticelake.sources import runs, scan
from noticelake.sources.idstream import id_stream
from noticelake.sources.lookup import KeyedTable
from noticelake.sources.merged import MergedUsers
from noticelake.sources.pages import read_users
from noticelake.sources.state import SeenIds, Watermark
from noticelake.store import fresh_path
from noticelake.streaming import digests, ingest, keyed


def _page(*parts):
    """HTML of literals and columns, & in columns escaped."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.replace(p.cast("string"), F.lit("&"), F.lit("&amp;")) for p in parts))


@query("select page_id, unnest([url, 'z' || url]) as href from pages")
def page_listing_links(spark, sf_dir):
    """H2: the first link of every listed item of a page's container."""
    url = F.col("url")
    made = _page('<p><a href="out">o</a></p><div id="main_content"><div class="list-item"><a href="', url, '">a</a><a href="second">b</a></div><div class="list-item">none</div><div class="x list-item"><p><a href="z', url, '">c</a></p></div></div>')
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.listing_links(made)).alias("href"))


@query("select cast(c_custkey as varchar) as data_id, c_name as header, c_mktsegment || ' end' as body, 'No time' as info_time from customer")
def page_transit_notices(spark, sf_dir):
    """H3: accordion groups as notices, a default for what is missing."""
    made = _page('<div id="infoAccordion"><div class="accordion-group" data-id="', F.col("c_custkey"), '"><a class="accordion-toggle"> ', F.col("c_name"), ' </a><div class="accordion-inner"><p>', F.col("c_mktsegment"), "</p> end</div></div></div>")
    return table(spark, sf_dir, "customer").select(F.inline(H.transit_notices(made)))


@query("select p_partkey, case when p_size % 2 = 0 then p_name end as title, p_brand as content, cast('2031-02-11' as date) as day from part")
def page_water_detail(spark, sf_dir):
    """H4, P5: title, date and content of a detail page; a page without a title has none."""
    title = F.when(F.col("p_size") % 2 == 0, _page("<h1>", F.col("p_name"), "</h1>")).otherwise("")
    made = F.concat(F.lit('<div id="main_content">'), title, _page('<i class="list-item-date"> 11.02.2031 г.</i><div class="view"><p>', F.col("p_brand"), "</p><p>more</p></div></div>"))
    page = table(spark, sf_dir, "part").select("p_partkey", H.water_detail(made).alias("page"))
    return page.select("p_partkey", "page.title", "page.content", T.event_date("page.date").alias("day"))


@query(
    "select s_suppkey as message_id, 'Първа ' || 'Град' as address, 'Първа Град Варна България' as full_address, '10:00' as start_time, case when s_suppkey % 2 = 0 then 42.5 end as lat "
    "from supplier where s_suppkey > 20 and s_suppkey % 5 <> 0"
)
def page_water_flow(spark, sf_dir):
    """Listings to geocoded addresses of new notices; every fifth page fails and is set aside."""
    listing = table(spark, sf_dir, "supplier").select(_page('<div id="main_content"><div class="list-item"><a href="/', F.col("s_suppkey"), '.html">x</a></div></div>').alias("html"))

    def fetch(url):
        if int(url[1:-5]) % 5 == 0:
            raise OSError("down")
        return '<div id="main_content"><h1>Без вода</h1><div class="view"><p>в гр. Град, ул. "Първа" от 10 ч.</p></div></div>'

    rows = flows.water(listing, 20, fetch).records
    gazetteer = spark.createDataFrame([("Първа Град", 42.5, 1.0), ("x", 0.0, 0.0)], "address string, lat double, lng double")
    return A.geocoded(rows, gazetteer).select("message_id", "address", "full_address", "start_time", F.when(F.col("message_id") % 2 == 0, F.col("lat")).alias("lat"))


@query("select s_suppkey as message_id, 'OSError: down' as error from supplier where s_suppkey % 7 = 0")
def page_water_retry(spark, sf_dir):
    """T5: pages that failed are tried again; what fails once more stays aside with its URL."""
    listing = table(spark, sf_dir, "supplier").select(_page('<div id="main_content"><div class="list-item"><a href="/', F.col("s_suppkey"), '.html">x</a></div></div>').alias("html"))

    def failing(step):
        def fetch(url):
            if int(url[1:-5]) % step == 0:
                raise OSError("down")
            return '<div id="main_content"><div class="view"><p>в гр. Град</p></div></div>'

        return fetch

    first = flows.water(listing, -1, failing(1))
    return flows.retried(first.quarantined, failing(7)).quarantined.select("message_id", "error")


@query("select cast(c_custkey as varchar) as data_id, (c_custkey % 300 + 1) || 'A' as line from customer c where not exists (select 1 from labels l where l.doc_id = c.c_custkey)")
def page_transit_flow(spark, sf_dir):
    """Transit pages to bus lines of notices that were not seen."""
    made = _page('<div id="infoAccordion"><div class="accordion-group" data-id="', F.col("c_custkey"), '"><a class="accordion-toggle">Промяна</a><div class="accordion-inner">маршрут на линия ', F.col("c_custkey") % 300 + 1, "a</div></div></div>")
    pages = table(spark, sf_dir, "customer").select(made.alias("html"))
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("data_id"))
    return flows.transit(pages, seen).records.select("original_message.data_id", F.explode("bus_lines").alias("line"))


@query(
    "with h as (select d.doc_id, d.lang, case when l.doc_id is null then 1 else 0 end as miss from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id), "
    "m as (select doc_id, lang, miss, sum(miss) over (order by doc_id rows between 19 preceding and current row) as m20 from h), "
    "st as (select min(doc_id) as stop_id from m where m20 = 20) "
    "select doc_id, lang from m where miss = 0 and doc_id <= coalesce((select stop_id from st), doc_id)"
)
def scan_in_waves(spark, sf_dir):
    """Ids are fetched upward in waves until twenty in a row are missing; a document's page is there if it has labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    there = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")

    def wave(ids):
        met = ids.join(there.withColumnRenamed("doc_id", "id"), "id", "left")
        return met.select("id", F.col("id").cast("string").alias("url"), F.col("lang").alias("html"), F.when(F.col("lang").isNull(), "PageMissing: no page").alias("error"))

    found = scan.scan_ids(spark, docs.agg(F.min("doc_id")).first()[0], wave, misses=20)
    return found.pages.select(F.col("id").alias("doc_id"), F.col("html").alias("lang"))


@query("select greatest(16000, max(doc_id)) + 1 as next_id from documents")
def watermark_state(spark, sf_dir):
    """The mark is stored, never falls, and gives the next id."""
    mark = Watermark(spark, fresh_path(spark, "mark"))
    mark.advance(table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0], 1)
    mark.advance(3, 2)
    return I.next_id(spark.createDataFrame([(mark.get(),)], "last_id long"))


@query("select cast(doc_id as varchar) as data_id from labels union select cast(doc_id as varchar) from documents")
def seen_ids_state(spark, sf_dir):
    """Ids of several batches, one of them run again, compacted and read distinct."""
    seen = SeenIds(spark, fresh_path(spark, "seen"), most_versions=2)
    for batch, name in ((0, "labels"), (1, "labels"), (2, "documents"), (2, "documents"), (3, "labels")):
        seen.add(table(spark, sf_dir, name).select(F.col("doc_id").alias("data_id")), batch)
    return seen.get()


def _recorded(spark, sf_dir):
    """Two runs: all documents, then the labelled ones with another message."""
    folder = fresh_path(spark, "runs")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("date"), F.col("source").alias("message"))
    runs.write_run(docs, folder, "2031-02-11a")
    runs.write_run(docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").withColumn("message", F.upper("message")), folder, "2031-02-11b")
    return folder


@query("select doc_id as id, lang as date, upper(source) as message from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def recorded_latest_run(spark, sf_dir):
    """The newest run, of as many files as it was written in."""
    return runs.latest_run(spark, _recorded(spark, sf_dir))


@query("select doc_id as id, lang as date, case when exists (select 1 from labels l where l.doc_id = d.doc_id) then upper(source) else source end as message from documents d")
def recorded_latest_by_id(spark, sf_dir):
    return runs.latest_by_id(spark, _recorded(spark, sf_dir))


@query("select 2 as total_runs, max(doc_id) as last_id from documents")
def recorded_status(spark, sf_dir):
    """A2: how many runs are on record, and the largest id of any."""
    return api.run_status(spark, _recorded(spark, sf_dir)).select("total_runs", "last_id")


@query("select doc_id as id, lang as date, source as message, case when l.doc_id is not null then '10:00' end as start_time from documents d left join (select distinct doc_id from labels) l using (doc_id) where 1 = 0")
def recorded_empty_run(spark, sf_dir):
    """The newest run has no rows and hides those before it."""
    folder = _recorded(spark, sf_dir)
    runs.write_run(table(spark, sf_dir, "documents").limit(0).select(F.col("doc_id").alias("id"), F.col("lang").alias("date"), F.col("source").alias("message")), folder, "2031-02-11c")
    parsed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.array(F.lit("x")).alias("locations"), F.lit("10:00").alias("start_time"), F.lit(None).cast("string").alias("end_time"))
    return api.current_outages(spark, folder, parsed).select("id", "date", "message", "start_time")


@query("select doc_id as id, lang as date, case when l.doc_id is not null then upper(source) else source end as message, case when l.doc_id is not null then '10:00' end as start_time, case when l.doc_id is not null then 'x' end as location, cast(null as double) as lat from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def recorded_current_outages(spark, sf_dir):
    """Notices of all runs, each as its newest run has it, with what was parsed of them."""
    parsed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.array(F.lit("x")).alias("locations"), F.lit("10:00").alias("start_time"), F.lit(None).cast("string").alias("end_time"))
    rows = api.current_outages(spark, _recorded(spark, sf_dir), parsed, newest_run_only=False)
    return rows.select("id", "date", "message", "start_time", F.col("locations")[0].alias("location"), "lat")


@query("select doc_id as id, upper(source) as message, '10:00' as start_time from documents where doc_id = (select max(doc_id) from labels where doc_id in (select doc_id from documents))")
def recorded_outage_by_id(spark, sf_dir):
    """F8: one served outage of the newest run."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    parsed = labels.select("id", F.array(F.lit("x")).alias("locations"), F.lit("10:00").alias("start_time"), F.lit(None).cast("string").alias("end_time"))
    wanted = labels.agg(F.max("id")).first()[0]
    return api.outage_by_id(api.current_outages(spark, _recorded(spark, sf_dir), parsed), wanted).select("id", "message", "start_time")


@query("select doc_id as id, lang as date, upper(source) as message, '10:00' as start_time from documents where doc_id in (select doc_id from labels)")
def lookup_outages_by_id(spark, sf_dir):
    """F8: the outages of many ids from a table that opens the folders of those ids alone."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    parsed = ids.select("id", F.array(F.lit("x")).alias("locations"), F.lit("10:00").alias("start_time"), F.lit(None).cast("string").alias("end_time"))
    served = api.outages_by_id(api.current_outages(spark, _recorded(spark, sf_dir), parsed, newest_run_only=False), fresh_path(spark, "served"))
    return served.get_many(ids, "id").select("id", "date", "message", "start_time")


@query("select c_custkey, c_name from customer where c_custkey in ((select min(c_custkey) from customer), (select max(c_custkey) from customer))")
def lookup_users_by_name(spark, sf_dir):
    """users by an address in other case and with spaces around, each look-up in one folder."""
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    held = KeyedTable.of(users, fresh_path(spark, "users"), "c_name", buckets=16, folded=True)
    ends = users.agg(F.min(F.struct("c_custkey", "c_name"))["c_name"].alias("a"), F.max(F.struct("c_custkey", "c_name"))["c_name"].alias("b")).first()
    return held.get(f" {ends.a.upper()}").unionByName(held.get(f"{ends.b.lower()} "))


@query("select event_id as id, cast(json_extract_string(props, '$.k') as integer) as k, 'm' as model from events")
def results_written(spark, sf_dir):
    """Raw results are stored as they came and parsed later."""
    path = fresh_path(spark, "results")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("raw_json"), F.lit("m").alias("model"), F.lit("h").alias("prompt_hash"))
    runs.write_results(rows, path)
    good, _ = E.parsed(spark.read.schema(rows.schema).parquet(path), "k int")
    return good.select("id", "parsed.k", "model")


@query("select c_custkey, case when c_custkey % 3 = 0 then sha256(c_name || chr(10) || c_mktsegment) else c_name end as data_id from customer")
def fallback_ids(spark, sf_dir):
    """Notices without an id get a hash of their text."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "No ID").otherwise(F.col("c_name")).alias("data_id"))
    return I.with_fallback_id(rows, "data_id", "No ID", ["c_name", "c_mktsegment"]).select("c_custkey", "data_id")


@query("select c_custkey from customer where c_mktsegment <> 'BUILDING' and c_custkey % 4 <> 0")
def valid_rows(spark, sf_dir):
    """both texts are there and not empty."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("date"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("message"))
    return rows.where(I.is_valid("date", "message")).select("c_custkey")


@query("select case event_id % 4 when 0 then 'empty' when 1 then 'empty' when 2 then 'malformed' else 'usable' end as kind, count(*) as n from events group by all")
def usable_batches(spark, sf_dir):
    """batches that hold something, hold nothing, or cannot be read."""
    kind = F.col("event_id") % 4
    content = F.when(kind == 0, " [ ]").when(kind == 1, "\n").when(kind == 2, F.concat(F.lit("["), "props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    found = E.usable_batches(table(spark, sf_dir, "events").select("event_id", content.alias("content")))
    told = [rows.select(F.lit(name).alias("kind")) for name, rows in zip(("usable", "empty", "malformed"), found, strict=True)]
    return told[0].unionByName(told[1]).unionByName(told[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("select o_orderkey, lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':30' as start_time, lpad(cast(o_orderkey % 7 + 10 as varchar), 2, '0') || ':00' as end_time, 'Първа' as street, 'Горен' as district from orders")
def flat_extractions(spark, sf_dir):
    """Flat locations and times out of a message."""
    message = F.concat(F.lit("Без вода от "), F.col("o_orderkey") % 24, F.lit(".30ч. до около "), F.col("o_orderkey") % 7 + 10, F.lit(' ч. по ул. "Първа" в кв. Горен.'))
    told = table(spark, sf_dir, "orders").select("o_orderkey", E.flat_extraction(message).alias("e"))
    return told.select("o_orderkey", "e.start_time", "e.end_time", F.col("e.locations")[0].alias("street"), F.col("e.locations")[1].alias("district"))


@query("select o_orderkey, (o_orderkey % 1440) >= 1320 or (o_orderkey % 1440) < 420 as quiet from orders")
def quiet_hours(spark, sf_dir):
    """Quiet hours that wrap around midnight."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1440).alias("m"), F.lit(1320).alias("a"), F.lit(420).alias("b"))
    return rows.select("o_orderkey", ingest.is_quiet("m", "a", "b").alias("quiet"))


@query("select n_regionkey as region, string_agg('N ' || n_name || ' R', ',' order by 'N ' || n_name || ' R') as addresses from nation group by n_regionkey")
def collected_addresses(spark, sf_dir):
    """The addresses of each notice as a list."""
    rows = A.with_address(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.lit("N").alias("street"), F.col("n_name").alias("sublocation"), F.lit("R").alias("location")))
    return A.collected(rows, "region").select("region", F.array_join("addresses", ",").alias("addresses"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 0 when c_custkey % 4 = 1 then 2 else 1 end as n_addresses from customer")
def user_addresses_replaced(spark, sf_dir):
    """C4: a user's list is replaced, also by an empty one, whatever the case of the address."""
    kind = "array<struct<street:string,neighborhood:string>>"
    one = F.array(F.struct(F.lit("s").alias("street"), F.lit("n").alias("neighborhood"))).cast(kind)
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email"), one.alias("addresses"))
    new = users.where("c_custkey % 4 < 2").select(F.concat(F.lit(" "), F.upper("email")).alias("email"), F.when(F.col("c_custkey") % 4 == 0, F.array().cast(kind)).otherwise(F.concat("addresses", "addresses")).alias("addresses"))
    return U.with_addresses(users, new).select("c_custkey", F.size("addresses").alias("n_addresses"))


@query("select case when c_custkey % 2 = 0 then upper(c_name) else c_name end as email, case when c_custkey % 2 = 0 then 2 else 0 end as version from customer")
def user_upsert_collisions(spark, sf_dir):
    """Of two changes of one user, written in different case, the later one holds."""
    users = table(spark, sf_dir, "customer").select(F.col("c_name").alias("email"), F.lit(0).alias("version"), "c_custkey")
    some = users.where("c_custkey % 2 = 0")
    changes = some.withColumns({"version": F.lit(1), "email": F.concat(F.lit(" "), F.lower("email"))}).unionByName(some.withColumns({"version": F.lit(2), "email": F.upper("email")}))
    return U.upserted(users, changes, "version").select("email", "version")


@query("select c_custkey, c_name from customer where c_name = 'Customer#000000007'")
def user_lookup_exact(spark, sf_dir):
    """The stored table, an address as it is written."""
    users = read_users(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    return U.by_email(users, "Customer#000000007", exact=True, email_col="c_name")


@query("select cast(c_custkey as varchar) as user_id, c_name as email from customer where c_custkey = 11")
def account_by_id(spark, sf_dir):
    """An account by the text of its id, without its password hash."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("email"), F.lit("secret").alias("password_hash"))
    return U.by_user_id(accounts, "11")


@query(
    "with l as (select n_regionkey id, n_name l from nation union select r_regionkey, r_name from region), h as (select distinct n_name d from nation), "
    "p as (select distinct id, d from l, h where contains(lower(l), lower(d)) or contains(lower(d), lower(l)) or len(list_filter(string_split(lower(d), ' '), lambda x: length(x) > 3 and contains(lower(l), x))) > 0) "
    "select distinct c_name as email, id from customer join nation on n_nationkey = c_nationkey join p on p.d = n_name"
)
def near_users_pairs(spark, sf_dir):
    """J3 for many users: a district names its region, so that each is near that one at least."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    outages = region.join(nation.select(F.col("n_regionkey").alias("r_regionkey"), "n_name"), "r_regionkey").groupBy("r_regionkey", "r_name").agg(F.collect_list("n_name").alias("names"))
    outages = outages.select(F.col("r_regionkey").alias("id"), F.array_append("names", F.col("r_name")).alias("locations"))
    users = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("email"), F.array(F.struct(F.col("n_name").alias("street"), F.col("n_name").alias("neighborhood"))).alias("addresses"))
    return S.near_users(outages, users)


@query("select cast(row_number() over (order by s) as bigint) as place, s as facet from (select distinct source as s from documents) union all select 0, 'all'")
def facet_menu(spark, sf_dir):
    """O2: the entry for everything, then the facets in order."""
    return S.facet_list(table(spark, sf_dir, "documents").select(F.array("source").alias("locations")), "locations")


def _streamed(spark, start, *columns):
    """What a stream that takes all there is leaves in its sink."""
    sink, state, checkpoint = (fresh_path(spark, name) for name in ("sink", "state", "check"))
    start(state, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select(*columns)


@query("select cast(doc_id as varchar) as data_id, toxic from labels")
def stream_unseen(spark, sf_dir):
    """A stream of files; a second pass over the same files finds nothing new."""
    frame = table(spark, sf_dir, "labels")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
    stream = lambda: ingest.file_stream(spark, f"{sf_dir}/labels*", schema, "parquet").select(F.col("doc_id").cast("string").alias("data_id"), "toxic")

    def start(state, sink, checkpoint):
        ingest.ingest_unseen(stream(), state, sink, checkpoint).awaitTermination()
        return ingest.ingest_unseen(stream(), state, sink, f"{checkpoint}-lost")

    return _streamed(spark, start, "data_id", "toxic")


@query("select event_id as id, event_type from events where event_id > 500")
def stream_above_mark(spark, sf_dir):
    """A stream of files above a mark."""
    frame = table(spark, sf_dir, "events")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
    stream = ingest.file_stream(spark, f"{sf_dir}/events*", schema, "parquet").select(F.col("event_id").alias("id"), "event_type")
    return _streamed(spark, lambda *paths: ingest.ingest_above(stream, *paths, default=500), "id", "event_type")


@query("select cast(d.doc_id as varchar) as data_id, d.lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def stream_unseen_keyed(spark, sf_dir):
    """The same by keyed state; labelled ids count as seen from the start, and a second start finds nothing new."""
    frame = table(spark, sf_dir, "documents")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)
    stream = lambda: ingest.file_stream(spark, f"{sf_dir}/documents*", schema, "parquet").select(F.col("doc_id").cast("string").alias("data_id"), "lang")
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("data_id"))

    def start(state, sink, checkpoint):
        keyed.ingest_unseen_keyed(stream(), sink, checkpoint, seen=seen).awaitTermination()
        return keyed.ingest_unseen_keyed(stream(), sink, checkpoint, seen=seen)

    return _streamed(spark, start, "data_id", "lang")


@query("select doc_id as id, lang, 'http://host/' || doc_id || '.html' as url from documents where doc_id > 50")
def stream_page_source(spark, sf_dir):
    """Pages above a mark through a streaming source whose offset is the last id; a second start finds nothing new."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    last = docs.agg(F.max("id")).first()[0]

    def start(state, sink, checkpoint):
        stream = id_stream(spark, lambda: last, lambda url: url, "http://host/", above=50)
        met = stream.select("id", "url").join(docs, "id")  # ids that are no documents fall out
        ingest.ingest_above(met, state, sink, checkpoint, default=50).awaitTermination()
        return ingest.ingest_above(met, state, sink, checkpoint, default=50)

    return _streamed(spark, start, "id", "lang", "url")


@query(
    "select c_custkey, case when c_custkey % 5 = 0 then upper(c_name) else c_name end as email, case when c_custkey % 5 = 0 then 2 else 1 end as version from customer where c_custkey % 7 <> 0 "
    "union all select -c_custkey, c_name || 'x', 3 from customer where c_custkey % 5 = 1"
)
def user_merge_on_read(spark, sf_dir):
    """Users are changed, deleted and registered by deltas beside a base that stays as it is."""
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email"), F.lit(1).alias("version"))
    stored = MergedUsers(spark, fresh_path(spark, "users"), "c_custkey long, email string, version int", share=10)
    stored.create(users)
    stored.upsert(users.where("c_custkey % 5 = 0").withColumns({"email": F.upper("email"), "version": F.lit(2)}))
    stored.delete(users.where("c_custkey % 7 = 0"))
    some = users.where("c_custkey % 5 = 1").withColumns({"c_custkey": -F.col("c_custkey"), "email": F.concat("email", F.lit("x")), "version": F.lit(3)})
    stored.register(some.unionByName(users.where("c_custkey % 5 = 2 and c_custkey % 7 <> 0")))  # the latter exist
    return stored.read()


@query("select c_custkey, 'exists' as reason from customer where c_custkey % 3 = 0 union all select c_custkey, 'repeated' from customer where c_custkey % 3 = 1")
def user_merge_refused(spark, sf_dir):
    """What a merged table refuses, before and after its deltas have become a base."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email"))
    stored = MergedUsers(spark, fresh_path(spark, "users"), "c_custkey long, email string")
    stored.create(rows.where("c_custkey % 6 = 0"))
    stored.upsert(rows.where("c_custkey % 6 = 3"))
    stored.settle(force=True)
    again = rows.where("c_custkey % 3 = 1")
    return stored.register(rows.where("c_custkey % 3 = 0").withColumn("email", F.upper("email")).unionByName(again).unionByName(again)).select("c_custkey", "reason")


@query("select doc_id, 'told ' || lang as said, case when doc_id % 2 = 0 then 'old' else 'new' end as model from documents")
def page_answers_kept(spark, sf_dir):
    """A second batch finds the answers of the first on record and asks for the rest alone; another model would have answered otherwise."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("lang", (F.col("doc_id") % 2).cast("string")).alias("text"))
    kept = memo.Memo(spark, fresh_path(spark, "answers"), memo.ANSWER)
    old = memo.extract_once(docs.where("doc_id % 2 = 0"), lambda system, text: system + text[:-1], "told ", "text", kept)
    old.count()

    def refuse(system, text):
        if text.endswith("0"):
            raise ValueError("asked again")
        return system + text[:-1]

    told = memo.extract_once(docs, refuse, "told ", "text", kept)
    return told.where("error is null").select("doc_id", F.col("raw_json").alias("said"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new").alias("model"))


@query("select c_custkey, cast(n_nationkey as double) as lat, case when n_nationkey % 4 <> 0 then cast(n_nationkey as double) end as known from customer join nation on n_nationkey = c_nationkey")
def page_places_kept(spark, sf_dir):
    """Distinct addresses are looked up once, those that are not found too; the second time the service is down and not missed."""
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", F.col("n_nationkey").cast("double").alias("key"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name")).alias("address"))
    kept = memo.Memo(spark, fresh_path(spark, "places"), memo.PLACE)

    def lookup(address):
        key = int(address.split()[0])
        return (float(key), 0.0) if key % 4 else None

    def down(address):
        raise OSError("down")

    memo.geocode_once(rows, lookup, kept).count()
    told = memo.geocode_once(rows, down, kept).where("error is null")
    return told.select("c_custkey", F.col("key").alias("lat"), F.col("lat").alias("known"))


_TRIGRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({0}) - 2, 1)), lambda i: substr({0}, i, 3)))"


@query(
    "with g as (select n_nationkey k, n_name || ' ' || r_name a from nation join region on n_regionkey = r_regionkey), "
    "c as (select c_custkey, left(a, p) || substr(a, p + 2) w from (select c_custkey, c_custkey % 6 + 1 p, a from customer join g on k = c_nationkey)), "
    f"x as (select w, {_TRIGRAMS.format('q')} t from (select distinct w, ' ' || lower(trim(w)) || ' ' q from c)), y as (select a, {_TRIGRAMS.format('q')} t from (select a, ' ' || lower(trim(a)) || ' ' q from g)), "
    "s as (select w, a, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) j from x, y), "
    "b as (select w, a, row_number() over (partition by w order by j desc, a) n from s where j >= 0.7 - 1e-9) "
    "select c_custkey, b.a as matched, cast(g.k as double) as lat from c left join b on b.w = c.w and b.n = 1 left join g on g.a = b.a"
)
def geocode_alike(spark, sf_dir):
    """Misspelt addresses take the place of the one most like them; the SQL compares all pairs."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.concat_ws(" ", "n_name", "r_name").alias("address"))
    at = (F.col("c_custkey") % 6 + 1).cast("int")
    misspelt = F.concat(F.substr("address", F.lit(1), at), F.substr("address", at + 2))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", misspelt.alias("address"))
    gazetteer = places.select("address", F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    return A.geocoded_alike(rows, gazetteer).select("c_custkey", "matched", "lat")


_SEARCHED = ("LICENSE", "the ", "zq", "éc", "und die")


@query(" union all ".join(f"select '{q}' as query, doc_id from documents where contains(lower(text), '{q.lower()}') or contains(lower(source), '{q.lower()}')" for q in _SEARCHED))
def search_by_index(spark, sf_dir):
    """texts and places that hold a query, found through an index of trigrams; two characters are the beginning of trigrams."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = textsearch.TrigramIndex(spark, fresh_path(spark, "trigrams"), buckets=16)
    index.build(docs, "doc_id", F.col("text"), F.col("source"))
    found = [index.search(docs, "doc_id", q, F.col("text"), F.col("source")).select(F.lit(q).alias("query"), "doc_id") for q in _SEARCHED]
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    return told


@query(
    "with k as (select distinct unnest(string_split(lower(text), ' ')) as w from benchmark), g as (select w, length(w) % 7 as r, 'about ' || w as name from k where length(w) >= 10), "
    "d as (select doc_id, lower(text) as t from documents), m as (select doc_id, min(struct_pack(r := r, name := name)) as b from d join g on contains(t, w) group by doc_id) "
    "select doc_id, coalesce(b.name, 'none') as keyword from documents left join m using (doc_id)"
)
def keyword_table_first(spark, sf_dir):
    """The first group of a table of keywords that a text holds, in the table's order; here the long words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("keyword")).where(F.char_length("keyword") >= 10).distinct()
    groups = words.select((F.char_length("keyword") % 7).alias("rank"), F.concat(F.lit("about "), "keyword").alias("name"), "keyword")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return textsearch.first_group(docs, F.col("text"), groups, "none", "keyword").select("doc_id", "keyword")


@query(
    "with s as (select event_id, user_id, ts, case user_id % 4 when 1 then date_trunc('day', ts) + interval 1 day when 2 then date_trunc('week', ts) + interval 7 day else ts end as p from events), "
    "q as (select event_id, user_id, p, (hour(p) >= 22 or hour(p) < 7) and user_id % 4 <> 3 as quiet from s), "
    "d as (select event_id, user_id, p, ts, case when quiet then cast(cast(p as date) as timestamp) + interval 7 hour + case when hour(p) >= 22 then interval 1 day else interval 0 day end else p end as due from q join events using (event_id, user_id)) "
    "select cast(user_id as varchar) as user, due, count(*) as n, string_agg(cast(event_id as varchar), ',' order by cast(event_id as varchar)) as ids from d "
    "where due <= (select max(ts) - interval 1 hour from events) or due = ts group by user_id, due, due = ts"
)
def stream_digests_waiting(spark, sf_dir):
    """A stream of notices, told at once, daily or weekly and not within quiet hours; what is not due yet waits."""
    events = table(spark, sf_dir, "events")
    kind = F.col("user_id") % 4
    frequency = F.when(kind == 1, "daily").when(kind == 2, "weekly").otherwise("instant")
    settings = events.select("user_id").distinct().select(F.col("user_id").cast("string").alias("email"), frequency.alias("frequency"), F.when(kind != 3, "22:00").alias("quiet_start"), F.when(kind != 3, "07:00").alias("quiet_end"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = ingest.file_stream(spark, f"{sf_dir}/events*", schema, "parquet").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("email"), F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, lambda state, sink, checkpoint: digests.send_waiting(stream, settings, sink, checkpoint), F.col("user"), F.col("due").cast("timestamp_ntz").alias("due"), "n", F.array_join("ids", ",").alias("ids"))
