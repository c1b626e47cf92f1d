"""Notices that wait: held through a user's quiet hours, or until their daily or weekly digest is due."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from noticelake.functions.text import bound
from noticelake.streaming.ingest import is_quiet, start
from noticelake.streaming.keyed import keyed_state

DAILY, WEEKLY = "daily", "weekly"


def minute_of(clock: Column | str) -> Column:
    """The minute of the day of an HH:MM text, null if it is none."""
    parts = F.regexp_extract_all(clock, F.lit("^([0-9]{1,2}):([0-9]{2})$"), F.lit(0))
    return F.when(F.size(parts) == 1, F.split_part(clock, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(clock, F.lit(":"), F.lit(2)).cast("int"))


def due(at: Column, frequency: Column, quiet_start: Column, quiet_end: Column) -> Column:
    """When a notice of ``at`` is told: at once, at the next midnight (daily) or Monday (weekly), and in no case within quiet hours.

    Quiet hours are minutes of the day, may wrap around midnight and end what they hold; without both ends, or with
    equal ones, there are none.  Any other frequency, also null, is at once.  Days are those of the session's time zone.
    """
    next_day = F.date_trunc("day", at) + F.expr("interval 1 day")
    next_week = F.date_trunc("week", at) + F.expr("interval 7 days")
    planned = F.when(frequency == DAILY, next_day).when(frequency == WEEKLY, next_week).otherwise(at)

    def told(time: Column) -> Column:
        minute = F.hour(time) * 60 + F.minute(time)
        over = F.timestamp_add("MINUTE", quiet_end, F.date_trunc("day", time) + F.when(quiet_end <= minute, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day")))
        hours = quiet_start.isNotNull() & quiet_end.isNotNull()
        return F.when(hours & is_quiet(minute, quiet_start, quiet_end), over).otherwise(time)

    return bound(planned, told)


def with_due(notices: DataFrame, settings: DataFrame, user_col: str = "email", ts_col: str = "ts") -> DataFrame:
    """Notices (user, ts) with ``due`` by their user's settings (email, frequency, quiet_start, quiet_end as HH:MM); a user without any is told at once.  Of several settings of a user the least by value count."""
    one = settings.groupBy(F.col("email").alias(user_col)).agg(F.min(F.struct("frequency", "quiet_start", "quiet_end")).alias("__s"))
    at = due(F.col(ts_col), F.col("__s.frequency"), minute_of(F.col("__s.quiet_start")), minute_of(F.col("__s.quiet_end")))
    return notices.join(one, user_col, "left").withColumn("due", at).drop("__s")


#: Keys that the notices of one time are dealt to, and those that are told at once.
PARTS, PARTS_AT_ONCE = 64, 1_024
#: Notices that a task adds to its state together.
HELD = 1_000


def _waiting() -> StatefulProcessor:
    """Holds the notices of one time and part until the watermark has passed that time."""

    class Waiting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "user string, due timestamp, id string")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
            at, now = int(key[0]), bool(key[1])
            if now or at <= timerValues.getCurrentWatermarkInMs():  # at once, or its time has passed
                for row in rows:
                    yield Row(user=row["user"], due=row["due"], now=now, id=row["id"])
                return
            if not self.held.exists():
                self.handle.registerTimer(at)
            told = ((row["user"], row["due"], row["id"]) for row in rows)
            while part := list(islice(told, HELD)):
                self.held.appendList(part)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
            for user, due, id_ in self.held.get():
                yield Row(user=user, due=due, now=False, id=id_)
            self.held.clear()

        def close(self) -> None:
            pass

    return Waiting()


def told_notices(notices: DataFrame, settings: DataFrame, id_col: str = "id", user_col: str = "email", ts_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """(user, due, now, id) of a stream of notices: those that need not wait at once, others once their time has passed by event time; start its query by :func:`send_waiting`.

    State is lists of the notices of one time, dealt to ``PARTS`` keys each whoever their users are, and a timer for each: a key costs as much as
    many rows.  Rows later than ``late`` are dropped, as by any window.  Rows without a user or a time are left out.
    """
    timed = notices.withWatermark(ts_col, late).where(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull())
    told = with_due(timed, settings, user_col, ts_col).withColumn("__now", F.col("due") == F.col(ts_col))
    rows = told.select(F.col(user_col).cast("string").alias("user"), "due", F.col(id_col).cast("string").alias("id"), ts_col, "__now")
    rows = rows.withColumn("__ms", F.when(F.col("__now"), F.lit(0)).otherwise(F.unix_millis("due")))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("user", "id", "due"), F.when(F.col("__now"), PARTS_AT_ONCE).otherwise(PARTS)))
    return rows.groupBy("__ms", "__now", "__part").transformWithState(_waiting(), "user string, due timestamp, now boolean, id string", "Append", "EventTime")


def as_digests(told: DataFrame) -> DataFrame:
    """(user, due, n, ids) of told notices (user, due, now, id); ids ascending, null ones last."""
    ids = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id")))
    grouped = told.groupBy("user", "due", "now").agg(F.count("*").alias("n"), ids.alias("ids"))
    return grouped.select("user", "due", "n", F.transform("ids", lambda x: x["id"]).alias("ids"))


def send_waiting(notices: DataFrame, settings: DataFrame, sink_path: str, checkpoint: str, poll: str | None = None, **columns: str) -> StreamingQuery:
    """Writes digests (user, due, n, ids) as they are due to ``sink_path/batch_id=<n>``; a batch that runs again replaces what it wrote.

    A notice whose digest was told in an earlier batch comes as a further one.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        as_digests(batch).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    with keyed_state(notices.sparkSession):
        return start(told_notices(notices, settings, **columns), each, checkpoint, poll)
