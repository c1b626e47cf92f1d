"""The read side: enriched notices, search, facets, what is near, and the state of ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enriched(notices: DataFrame, parsed: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Each notice with the parsed columns of its id, null where nothing was parsed; one result an id."""
    return notices.join(parsed.select(on, *columns).dropDuplicates([on]), on, "left")


def current_outages(notices: DataFrame, parsed: DataFrame) -> DataFrame:
    """Served rows: notice, extraction (which overwrites, also with null) and empty coordinates."""
    rows = enriched(notices, parsed, "id", ["locations", "start_time", "end_time"])
    return rows.select("id", "date", "message", "locations", "start_time", "end_time", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))


def by_id(rows: DataFrame, ident: int, id_col: str = "id") -> DataFrame:
    """The row of an id; of several the first by their values."""
    return rows.where(F.col(id_col) == ident).orderBy(*rows.columns).limit(1)


def search(rows: DataFrame, query: str, facet: str = "all", text_col: str = "message", locations_col: str = "locations") -> DataFrame:
    """Rows with the query in text or any location, whatever the case, and the facet among the locations."""
    wanted = F.lower(F.lit(query))
    hit = F.coalesce(F.contains(F.lower(text_col), wanted), F.lit(False)) | F.coalesce(F.exists(locations_col, lambda x: F.contains(F.lower(x), wanted)), F.lit(False))
    rows = rows.where(hit) if query else rows
    return rows if facet == "all" else rows.where(F.coalesce(F.array_contains(locations_col, facet), F.lit(False)))


def facets(rows: DataFrame, array_col: str, name: str = "facet") -> DataFrame:
    """The distinct elements of an array column."""
    return rows.select(F.explode(array_col).alias(name)).distinct()


def facet_list(rows: DataFrame, array_col: str, first: str = "all", name: str = "facet") -> DataFrame:
    """(place, facet) as a menu shows it: the entry for everything, then the distinct elements in order."""
    found = facets(rows, array_col, name).where(F.col(name).isNotNull())
    every = rows.sparkSession.createDataFrame([(0, first)], f"place long, {name} string")
    # a menu's entries are a dimension of the served table: numbered in one place
    return every.unionByName(found.select(F.row_number().over(Window.orderBy(name)).cast("long").alias("place"), name))


def is_near(location: Column, districts: Column) -> Column:
    """A location and any district contain one another, or a long word of the district is in the location."""
    place = F.lower(location)

    def meets(name: Column) -> Column:
        name = F.lower(name)
        words = F.exists(F.split(name, " "), lambda w: (F.char_length(w) > 3) & F.contains(place, w))
        return F.contains(place, name) | F.contains(name, place) | words

    return F.exists(districts, meets)


def near(outages: DataFrame, districts: list[str], locations_col: str = "locations") -> DataFrame:
    """Outages near one user's districts."""
    if not districts:
        return outages.limit(0)
    mine = F.array(*map(F.lit, districts))
    return outages.where(F.coalesce(F.exists(locations_col, lambda x: is_near(x, mine)), F.lit(False)))


def near_users(outages: DataFrame, users: DataFrame, id_col: str = "id", locations_col: str = "locations", user_col: str = "email") -> DataFrame:
    """(user, outage) pairs for many users.

    The predicate is decided once for each distinct pair of a location and a
    district, which are dimensions far smaller than outages and users; both
    sides then follow by equality joins.
    """
    places = outages.select(F.col(id_col), F.explode(locations_col).alias("location")).distinct()
    homes = users.select(F.col(user_col), F.explode("addresses.neighborhood").alias("district")).distinct()
    met = contains_pairs(places.select("location").distinct(), homes.select("district").distinct())
    return homes.join(met, "district").join(places, "location").select(user_col, id_col).distinct()


def contains_pairs(locations: DataFrame, districts: DataFrame) -> DataFrame:
    """(location, district) pairs that are near, found through shared pieces of text.

    If one holds the other, or a word of it, they share the first three
    characters of what is held; shorter texts meet under their whole and empty
    ones under a mark of their own, so that candidates come from equality joins
    and nothing is missed.
    """

    def pieces(text: Column) -> Column:
        text = F.lower(text)
        at = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
        every = F.flatten(F.transform(at, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(text, i, n))))
        return F.array_distinct(F.concat(every, F.array(F.lit(""))))

    def heads(text: Column) -> Column:
        return F.array_distinct(F.transform(F.concat(F.array(F.lower(text)), F.filter(F.split(F.lower(text), " "), lambda w: F.char_length(w) > 3)), lambda w: F.substr(w, F.lit(1), F.lit(3))))

    place, home = locations.select("location", F.explode(pieces(F.col("location"))).alias("piece")), districts.select("district", F.explode(heads(F.col("district"))).alias("piece"))
    held = place.join(home, "piece").select("location", "district")
    place, home = locations.select("location", F.substr(F.lower("location"), F.lit(1), F.lit(3)).alias("piece")), districts.select("district", F.explode(pieces(F.col("district"))).alias("piece"))
    holds = place.join(home, "piece").select("location", "district")
    return held.unionByName(holds).distinct().where(is_near(F.col("location"), F.array("district")))


def run_status(runs: DataFrame, at_col: str, run: Column, id_col: str) -> DataFrame:
    """One row: how many runs, when the last one was, the largest id."""
    return runs.agg(F.count_distinct(run).alias("total_runs"), F.max(at_col).alias("last_run"), F.max(id_col).alias("last_id"))


def of_latest(rows: DataFrame, run: Column) -> DataFrame:
    """The rows of the latest run."""
    last = rows.agg(F.max(run).alias("last"))
    return rows.where(run == last.scalar())
