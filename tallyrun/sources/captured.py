"""Captured search responses as sources of their own format: one contract, one class a kind of response.

A source is read by ``spark.read.format(name).option("path", uri).load()``.  Responses are Parquet with query, captured_at and body; the partitions are its row
groups, equality and set filters on query go down to the Parquet reader, and only the columns that are needed are read.  Uris are those of
``pyarrow.fs`` (file, hdfs, s3, gs), so executors read them where they run.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

Hit = tuple[str, str, str]


@dataclass
class RowGroup(InputPartition):
    uri: str
    group: int


class Responses(DataSourceReader):
    """Reads the row groups of captured responses and turns each body into hits by the source's own rule."""

    def __init__(self, source: type[CapturedSource], path: str):
        self.source, self.path = source, path
        self.wanted: list[list] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters that name the values of ``query``; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self.wanted.append([f.value])
            elif isinstance(f, In) and f.attribute == ("query",):
                self.wanted.append(list(f.value))
            else:
                yield f

    def _files(self) -> Iterator[tuple[object, str]]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True)) if found.type == fs.FileType.Directory else [found]
        yield from ((system, x.path) for x in sorted(infos, key=lambda x: x.path) if x.is_file and x.path.endswith(".parquet"))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq

        return [RowGroup(path, k) for system, path in self._files() for k in range(pq.ParquetFile(path, filesystem=system).metadata.num_row_groups)] or [RowGroup("", 0)]

    def read(self, partition: RowGroup) -> Iterator[tuple]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        if not partition.uri:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        for batch in pq.ParquetFile(partition.uri, filesystem=system).iter_batches(row_groups=[partition.group], columns=["query", "body"]):
            table = pa.Table.from_batches([batch])
            for values in self.wanted:
                table = table.filter(pc.is_in(table.column("query"), pa.array(values, pa.string())))
            for query, body in zip(table.column("query").to_pylist(), table.column("body").to_pylist(), strict=True):
                for k, (url, title, snippet) in enumerate(self.source.hits(body or "")):
                    yield query, k, url, title, snippet


class CapturedSource(DataSource):
    """The contract: a name, and ``hits`` of a response body; a body that breaks its format has none."""

    @classmethod
    def hits(cls, body: str) -> Iterator[Hit]:
        raise NotImplementedError

    def schema(self) -> str:
        return "query string, position int, url string, title string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return Responses(type(self), self.options["path"])


class CapturedFeeds(CapturedSource):
    """RSS responses."""

    @classmethod
    def name(cls) -> str:
        return "captured_feeds"

    @classmethod
    def hits(cls, body: str) -> Iterator[Hit]:
        try:
            items = ElementTree.fromstring(body).iter("item")
        except ElementTree.ParseError:
            return
        for item in items:
            url, title, snippet = ((item.findtext(x) or "").strip() for x in ("link", "title", "description"))
            if url:
                yield url, title, snippet


class CapturedHits(CapturedSource):
    """JSON responses with ``results``."""

    @classmethod
    def name(cls) -> str:
        return "captured_hits"

    @classmethod
    def hits(cls, body: str) -> Iterator[Hit]:
        try:
            results = json.loads(body)["results"]
        except (ValueError, KeyError, TypeError):
            return
        for x in results if isinstance(results, list) else []:
            if isinstance(x, dict) and isinstance(x.get("url"), str) and x["url"].strip():
                yield x["url"].strip(), str(x.get("title") or ""), str(x.get("content") or "")


SOURCES: tuple[type[CapturedSource], ...] = (CapturedFeeds, CapturedHits)


def read_captured(spark: SparkSession, source: type[CapturedSource], path: str) -> DataFrame:
    """Hits of captured responses; registers the source and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).load()
