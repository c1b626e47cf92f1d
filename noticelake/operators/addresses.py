"""Addresses out of nested locations, and their coordinates from a gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITY_SUFFIX = "Варна България"


def flattened(rows: DataFrame, locations: str = "locations", keep: list[str] | None = None) -> DataFrame:
    """One row for each street, or sublocation without streets, or location without sublocations.

    address joins street, sublocation and location, what is null left out;
    full_address adds city and country.  Rows without locations give none.
    """
    keep = keep or []
    location = rows.select(*keep, F.explode(locations).alias("l"))
    sub = location.select(*keep, F.col("l.location_name").alias("location"), F.explode_outer("l.sublocations").alias("s"))
    street = sub.select(*keep, "location", F.col("s.sublocation_name").alias("sublocation"), F.explode_outer("s.streets").alias("street"))
    return with_address(street)


def with_address(rows: DataFrame) -> DataFrame:
    """Adds address and full_address to street, sublocation, location."""
    address = F.concat_ws(" ", "street", "sublocation", "location")
    return rows.withColumn("address", address).withColumn("full_address", F.concat_ws(" ", "address", F.lit(CITY_SUFFIX)))


def geocoded(addresses: DataFrame, gazetteer: DataFrame, on: str = "address") -> DataFrame:
    """Adds lat and lng where the gazetteer (address, lat, lng) has the address, of several places the least."""
    known = gazetteer.groupBy(F.col("address").alias(on)).agg(F.min(F.struct("lat", "lng")).alias("__at"))
    return addresses.join(known, on, "left").withColumns({"lat": F.col("__at.lat"), "lng": F.col("__at.lng")}).drop("__at")


def collected(addresses: DataFrame, key: str) -> DataFrame:
    """The addresses of each key as a list, for keys with bounded lists such as a notice."""
    return addresses.groupBy(key).agg(F.sort_array(F.collect_list("address")).alias("addresses"))


def _trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, with a blank at both ends."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    at = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - 2, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(padded, i, F.lit(3))))


def alike(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = 0.7) -> DataFrame:
    """(left_col, right_col, likeness) of distinct texts whose trigrams have a Jaccard coefficient of at least ``threshold``.

    Two such texts share one of their rarest trigrams: so few of them that the rest alone could not
    reach the threshold.  Candidates come from equality joins on these, those whose sizes
    are too different fall out, and what is left is compared; no pair is missed.  Null texts are like none.
    """
    sides = [rows.select(F.col(f"`{c}`").alias("text")).where("text is not null").distinct().withColumn("grams", _trigrams(F.col("text"))) for rows, c in ((left, left_col), (right, right_col))]
    tokens = [side.select("text", F.explode("grams").alias("gram")) for side in sides]
    often = tokens[0].unionByName(tokens[1]).groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(side: DataFrame, name: str) -> DataFrame:
        ranked = side.join(often, "gram").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("t"))  # a text's own trigrams
        size = F.size("t")
        head = F.slice("t", F.lit(1), (size - F.ceil(threshold * size - F.lit(1e-9)) + 1).cast("int"))
        return ranked.select(F.col("text").alias(name), F.col("t.gram").alias(f"{name}_grams"), F.explode(head["gram"]).alias("gram"))

    met = rarest(tokens[0], "l").join(rarest(tokens[1], "r"), "gram")
    sizes = (F.size("l_grams"), F.size("r_grams"))
    near = met.where(F.least(*sizes) >= threshold * F.greatest(*sizes) - 1e-9).drop("gram").dropDuplicates(["l", "r"])
    shared = F.size(F.array_intersect("l_grams", "r_grams"))
    scored = near.withColumn("likeness", shared / (sizes[0] + sizes[1] - shared))
    return scored.where(F.col("likeness") >= threshold - 1e-9).select(F.col("l").alias(left_col), F.col("r").alias(right_col), "likeness")


def geocoded_alike(addresses: DataFrame, gazetteer: DataFrame, on: str = "address", threshold: float = 0.7) -> DataFrame:
    """As :func:`geocoded`, but an address that the gazetteer lacks takes the place of the one most like it, of equals the first by name; ``matched`` is the address that was found."""
    exact = gazetteer.select(F.col("address").alias("matched")).where("matched is not null").distinct()
    wanted = addresses.select(F.col(f"`{on}`").alias("wanted")).where("wanted is not null").distinct()
    missing = wanted.join(exact.withColumnRenamed("matched", "wanted"), "wanted", "left_anti")
    best = alike(missing, exact, "wanted", "matched", threshold).groupBy("wanted").agg(F.min(F.struct(-F.col("likeness"), "matched")).alias("b")).select("wanted", "b.matched")
    every = best.unionByName(wanted.join(exact.withColumnRenamed("matched", "wanted"), "wanted", "left_semi").select("wanted", F.col("wanted").alias("matched")))
    joined = addresses.join(every.withColumnRenamed("wanted", on), on, "left")
    return geocoded(joined, gazetteer.withColumnRenamed("matched", "__own") if "matched" in gazetteer.columns else gazetteer, "matched")
