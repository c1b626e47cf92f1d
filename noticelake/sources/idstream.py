"""Pages by ascending id as a streaming source of its own: the offset is the last id, a batch is a range of ids.

Spark keeps the offset in the query's checkpoint: what a batch fetched is fetched again only if the batch
itself runs again.  The driver asks for the newest id alone; pages are fetched in tasks, a range each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from noticelake.sources.pages import Fetcher

PAGES = "id long, url string, html string, error string"


class _Range(InputPartition):
    """Ids from the first up to, and without, the end."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _ranges(first: int, end: int, parts: int) -> list[_Range]:
    """``parts`` ranges of about equal length at most, together all ids from ``first`` to before ``end``."""
    size = max(1, -(-(end - first) // parts))
    return [_Range(k, min(k + size, end)) for k in range(first, end, size)]


class _Reader(DataSourceStreamReader):
    def __init__(self, newest: Callable[[], int | None], fetch: Fetcher, prefix: str, above: int, parts: int, most: int | None):
        self.newest, self.fetch, self.prefix, self.above, self.parts, self.most = newest, fetch, prefix, above, parts, most
        self.last = above

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.above}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.newest()
        goal = self.last if found is None else max(self.last, found)  # a listing that shrinks takes nothing back
        self.last = goal if self.most is None else min(goal, self.last + self.most)
        return {"id": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["id"])  # also of a batch that a restart runs again
        return _ranges(start["id"] + 1, end["id"] + 1, self.parts)

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: _Range) -> Iterator[tuple]:
        for ident in range(partition.first, partition.end):
            url = f"{self.prefix}{ident}.html"
            try:
                yield ident, url, self.fetch(url), None
            except Exception as e:  # noqa: BLE001
                yield ident, url, None, f"{type(e).__name__}: {e}"


def id_stream(spark: SparkSession, newest: Callable[[], int | None], fetch: Fetcher, prefix: str, above: int = 0, parts: int = 4, most: int | None = None, name: str = "noticelake_pages") -> DataFrame:
    """The stream (id, url, html, error) of pages with ids above ``above``, up to what ``newest`` says whenever the source is polled.

    ``newest`` runs on the driver, for instance on a listing page, and may give None where it lists none;
    ``fetch`` runs in tasks, ``parts`` ranges at a time.  A page that fails is a row with its
    error and is not asked for again.  ``most`` bounds how far the mark moves at once, for sources that were left alone for long; with
    a trigger that takes what there is and ends, it ends there.  ``name`` is what the source is registered as.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return _Reader(newest, fetch, prefix, above, parts, most)

    spark.dataSource.register(Pages)
    return spark.readStream.format(name).load()
