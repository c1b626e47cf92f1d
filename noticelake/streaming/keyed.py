"""Ids that were processed as keyed state: a batch asks for its own ids, whatever came before.

The state is in Spark's state store, one value a key, which lies with the checkpoint and is
read by key; with the ids as a table instead (:mod:`noticelake.sources.state`) every batch reads all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from noticelake.streaming.ingest import start

#: The state store that serves keyed state of this kind, and what keeps its commits as small as their changes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Keys that rows without an id are dealt to.
SALTS = 64


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes with it when it starts; the session has its own again behind it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _first_time(columns: list[str], dedup: bool) -> StatefulProcessor:
    """Lets through the rows of a key that has no state yet, all of that batch or one, and leaves its state."""
    made = Row(*columns)

    class FirstTime(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "at boolean")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
            if key[0] is not None:
                if self.seen.exists():
                    return
                self.seen.update((True,))
            for row in rows:
                yield made(*row[: len(columns)])
                if dedup and key[0] is not None:
                    return

        def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
            self.seen.update((True,))

        def close(self) -> None:
            pass

    return FirstTime()


def unseen_stream(stream: DataFrame, id_col: str = "data_id", seen: DataFrame | None = None, dedup: bool = False) -> DataFrame:
    """The rows of a stream whose id no earlier batch had; start its query within :func:`keyed_state`.

    ``seen`` (with ``id_col``) are ids that count as seen before the first batch; it is read when the query
    first starts and not when it starts again.  Rows that share an id within the batch all stay, unless
    ``dedup`` is set.  Rows without an id are never seen, leave no state and are dealt to many keys.
    """
    ident, columns = F.col(f"`{id_col}`"), [F.col(f"`{c}`") for c in stream.columns]
    salt = F.when(ident.isNull(), F.pmod(F.xxhash64(*columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    keyed = stream.select(*columns, ident.cast("string").alias("__id"), salt.alias("__salt")).groupBy("__id", "__salt")
    known = None
    if seen is not None:
        known = seen.where(ident.isNotNull()).select(ident.cast("string").alias("__id"), F.lit(0).alias("__salt")).distinct().groupBy("__id", "__salt")
    return keyed.transformWithState(_first_time(stream.columns, dedup), stream.schema, "Append", "None", known)


def keyed_state(spark: SparkSession):
    """The settings under which a query with keyed state starts."""
    return _settings(spark, STORE)


def ingest_unseen_keyed(stream: DataFrame, sink_path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, id_col: str = "data_id", seen: DataFrame | None = None, dedup: bool = False, poll: str | None = None) -> StreamingQuery:
    """Writes rows with ids that no earlier batch had to ``sink_path/batch_id=<n>``, as :func:`noticelake.streaming.ingest.ingest_unseen` does.

    What was seen is known by the checkpoint.  A batch that runs again after a failure meets the state of the
    batch before it, writes the same rows and replaces what it wrote.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    with keyed_state(stream.sparkSession):
        return start(unseen_stream(stream, id_col, seen, dedup), each, checkpoint, poll)
