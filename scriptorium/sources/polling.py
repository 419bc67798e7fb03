"""A stream that polls a paged listing of documents: the newest page and the backlog in turn.

Each poll reads one page. After the newest page, if more pages follow, comes the next page
of the backlog; after that the newest again. The backlog starts over at page 2 behind its
last page, when the signature of the listing (address, tag, page size) changes, and when
a page can't be read, as a listing that shrank has lost its later pages. Where the stream
stands is its offset, so a restarted query goes on with the poll after the last one; a
batch that was planned and not committed is polled again from its own start.

A poll that fails gives one row with its error and no document. Pages are bounded by the
page size, so a poll is read in one place; what follows is a stream like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

POLLED = "poll long, page long, id long, title string, modified string, error string"
#: Characters of an error that are kept.
ERROR_CHARS = 1000


def first_offset(signature: str, poll: int = 0) -> dict:
    return {"signature": signature, "poll": poll, "backlog": 2, "backlog_next": False}


def page_of(at: dict) -> int:
    """The page that the poll at this offset reads."""
    return at["backlog"] if at["backlog_next"] else 1


def offset_after(at: dict, more: bool | None) -> dict:
    """The offset after a poll; more: whether pages follow the one that was read, None if it could not be read."""
    page, new = page_of(at), {**at, "poll": at["poll"] + 1}
    if more is None:
        return {**new, "backlog": 2, "backlog_next": False}
    if page == 1:
        return {**new, "backlog": at["backlog"] if more else 2, "backlog_next": more}
    return {**new, "backlog": page + 1 if more else 2, "backlog_next": False}


def polled(spark: SparkSession, fetch: Callable[[int], tuple[Iterable[tuple], bool]], signature: str) -> DataFrame:
    """The stream of polls; fetch(page) gives rows (id, title, modified), newest first, and whether pages follow."""

    def poll(at: dict) -> tuple[list[tuple], dict]:
        if at["signature"] != signature:
            at = first_offset(signature, at["poll"])
        page = page_of(at)
        try:
            rows, more = fetch(page)
            found = [(at["poll"], page, *row, None) for row in rows]
        except Exception as failure:  # of any kind of listing; it is put out as a row
            return [(at["poll"], page, None, None, None, str(failure)[:ERROR_CHARS])], offset_after(at, None)
        return found, offset_after(at, bool(more))

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return first_offset(signature)

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, end = poll(start)
            return iter(rows), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            while start["poll"] < end["poll"]:
                rows, start = poll(start)
                yield from rows

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return "scriptorium_polled"

        def schema(self) -> str:
            return POLLED

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader()

    spark.dataSource.register(Polled)
    return spark.readStream.format("scriptorium_polled").load()
