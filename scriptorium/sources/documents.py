"""Document sources: listings, reverse lookups, resources page by page, binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"tags": "tag", "correspondents": "correspondent", "document_types": "document_type", "custom_fields": "custom_field"}


def document(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.filter(F.col("id") == doc_id)


def listing(documents: DataFrame, page_size: int, page: int = 1, tag: int | None = None) -> tuple[DataFrame, bool]:
    """A page of documents, newest first, and whether there is another."""
    rows = documents.select("id", "title", "modified", "added", "tags")
    rows = rows if tag is None else rows.filter(F.array_contains("tags", tag))
    some = rows.orderBy(F.desc("modified"), "id").offset((page - 1) * page_size).limit(page_size + 1)
    return some.limit(page_size), some.count() > page_size


def ids_with(documents: DataFrame, kind: str, entity: int) -> DataFrame:
    has = F.array_contains("tags", entity) if kind == "tag" else F.col(kind) == entity
    return documents.filter(has).select("id")


def catalog(resources: dict[str, DataFrame]) -> DataFrame:
    """One vocabulary of the four resources."""
    frames = [f.withColumn("kind", F.lit(KINDS[name])) for name, f in resources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def paged_resource(spark: SparkSession, fetch: Callable[[int], Iterable[tuple]], pages: int, schema: str = "id long, name string, document_count long") -> DataFrame:
    """A resource read page by page: fetch gives the rows of a page (from 1); one partition a page.

    fetch runs on the executors and travels to them by value.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(1, pages + 1)]

        def read(self, partition):
            yield from (tuple(r) for r in fetch(partition.value))

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "scriptorium_paged"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Paged)
    return spark.read.format("scriptorium_paged").load()


def followed_resource(spark: SparkSession, fetch: Callable[[str | None], tuple[Iterable[tuple], str | None]], base: str, schema: str = "id long, name string, document_count long") -> DataFrame:
    """A resource whose pages name the next one: fetch(address) gives rows and the next address or null; null asks for the first.

    Pages are read one after another in one task, as each is only known from the one before.
    An address that leaves scheme and host of the base is an error.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            from urllib.parse import urlparse

            home, at = urlparse(base)[:2], None
            while True:
                rows, at = fetch(at)
                yield from (tuple(r) for r in rows)
                if not at:
                    return
                if at.startswith(("http://", "https://")) and urlparse(at)[:2] != home:
                    raise ValueError("the next page is on another host")

    class Followed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "scriptorium_followed"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Followed)
    return spark.read.format("scriptorium_followed").load()
