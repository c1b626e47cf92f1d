"""Users: lookups, and changes as whole new tables (upsert, delete, addresses)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import district, folded_key, strip


def by_email(users: DataFrame, email: str, exact: bool = False, email_col: str = "email") -> DataFrame:
    """The user of an address, case and outer white space aside; of several the first by address."""
    same = F.col(email_col) == email if exact else folded_key(email_col) == folded_key(F.lit(email))
    return users.where(same).orderBy(email_col).limit(1)


def exists(users: DataFrame, email: str, exact: bool = False) -> bool:
    return not by_email(users, email, exact).isEmpty()


def by_user_id(accounts: DataFrame, user_id: str) -> DataFrame:
    """The account whose id reads as that text; the password hash is no part of it."""
    return accounts.where(F.col("user_id").cast("string") == user_id).limit(1).select(*(c for c in accounts.columns if c != "password_hash"))


def one_each(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each address, case and outer white space aside: the last by ``order`` (a column), of equal ones the largest row; none of rows without an address."""
    return _ranked(rows, order, SUPERSEDED, first=False).where("reason is null").drop("reason")


def upserted(users: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """The table with the changed users in place of those of the same address; of changes of one user the last by ``order`` holds.

    Changes without an address change nothing; :func:`unapplied` has them.
    """
    last = _ranked(changes, order, SUPERSEDED, first=False).where("reason is null").drop("reason")
    return deleted(users, last).unionByName(last.select(*users.columns))


def unapplied(changes: DataFrame, order: str | None = None) -> DataFrame:
    """The changes that :func:`upserted` does not apply, with ``reason``: superseded by a later one, or without an address."""
    return _ranked(changes, order, SUPERSEDED, first=False).where("reason is not null")


def deleted(users: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the users of these addresses."""
    keys = gone.select(folded_key("email").alias("__key")).distinct()
    return users.withColumn("__key", folded_key("email")).join(keys, "__key", "left_anti").drop("__key")


#: Why a row of a batch is not applied.
NO_ADDRESS, EXISTS, REPEATED, SUPERSEDED = "no address", "exists", "repeated", "superseded"


def _ranked(batch: DataFrame, order: str | None, reason: str, first: bool) -> DataFrame:
    """(columns of the batch, reason) of each of its rows: null for the first or last row of an address by ``order`` (a column), else why it does not count.

    Of equal rows one counts.  Rows are counted before they are compared, so that an
    address of any number of rows is one row a task; rows without an address are told
    by themselves and never compared.
    """
    columns = [F.col(f"`{c}`") for c in batch.columns]
    key = folded_key("email")
    named = F.coalesce(key != "", F.lit(False))
    counted = batch.where(named).groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__key", key)
    by = F.struct(*([F.col(f"`{order}`")] if order else []), *columns)
    pick = F.min if first else F.max
    best = counted.groupBy("__key").agg(pick(by).alias("__best"))
    met = counted.join(best, "__key").withColumn("__wins", by.eqNullSafe(F.col("__best")))
    copies = F.when(F.col("__wins"), F.concat(F.array(F.lit(None).cast("string")), F.array_repeat(F.lit(reason), (F.col("__n") - 1).cast("int"))))
    told = met.select(*columns, F.explode(copies.otherwise(F.array_repeat(F.lit(reason), F.col("__n").cast("int")))).alias("reason"))
    return told.unionByName(batch.where(~named).select(*columns, F.lit(NO_ADDRESS).alias("reason")))


def judged(users: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The registrations with ``reason``: null for those that are accepted, each row as often as it was given.

    A registration is refused if its address exists, case and outer white space aside, if it
    is not the first of its address in the batch by ``order`` (a column; of equal ones the
    least row), or if it has none.
    """
    keys = users.select(folded_key("email").alias("__key")).distinct().withColumn("__known", F.lit(True))
    told = _ranked(new, order, REPEATED, first=True).withColumn("__key", folded_key("email")).join(keys, "__key", "left")
    return told.select(*(F.col(f"`{c}`") for c in new.columns), F.when(F.coalesce("__known", F.lit(False)), EXISTS).otherwise(F.col("reason")).alias("reason"))


def registered(users: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(users with the new ones added, the others of the new with ``reason``), as :func:`judged` decides."""
    told = judged(users, new, order)
    return users.unionByName(told.where("reason is null").drop("reason")), told.where("reason is not null")


def with_addresses(users: DataFrame, addresses: DataFrame) -> DataFrame:
    """The table with the addresses of (email, addresses) in place of the user's own, an empty list too."""
    new = one_each(addresses.select("email", "addresses")).select(folded_key("email").alias("__key"), F.col("addresses").alias("__new"))
    joined = users.withColumn("__key", folded_key("email")).join(new, "__key", "left")
    return joined.select(*(F.coalesce("__new", "addresses").alias(c) if c == "addresses" else F.col(c) for c in users.columns))


def address_added(addresses: Column | str, street: Column) -> Column:
    """The list with a street and its district behind, unless the street is blank."""
    clean = strip(street)
    added = F.array_append(addresses, F.struct(clean.alias("street"), district(clean).alias("neighborhood")))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.col(addresses) if isinstance(addresses, str) else addresses).otherwise(added)


def address_removed(addresses: Column | str, index: int) -> Column:
    """The list without its element at that place, counted from 0."""
    return F.filter(addresses, lambda _, i: i != index)
