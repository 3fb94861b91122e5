"""A crawl adapter as a batch source: discovers the documents of a stored site by its link pages and fetches them.

A site is a folder of JSON lines {"url", "links", "body"} that a crawler left in the shared folder. The driver reads
only the names of its files; each task takes some of them, filters that compare the URL are applied before a body is
read into a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains, StringStartsWith

from gneiss.shared import ship, written

SCHEMA = "url string, links array<string>, body string"
_KIND = pa.schema([("url", pa.string()), ("links", pa.list_(pa.string())), ("body", pa.string())])
#: Rows in an Arrow batch.
BATCH = 250


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class StoredSite(DataSource):
    """Format "gneiss_site"; options path, and files (of a partition, default 4)."""

    @classmethod
    def name(cls) -> str:
        return "gneiss_site"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SiteReader(self.options)


class SiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.files, self.filters = options["path"], int(options.get("files", 4)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith, StringContains)) and f.attribute == ("url",):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, at = fs.FileSystem.from_uri(self.path)
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def wanted(self, url: str | None) -> bool:
        test = {EqualTo: lambda u, v: u == v, StringStartsWith: str.startswith, StringContains: str.__contains__}
        return all(url is not None and test[type(f)](url, f.value) for f in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        for path in partition.paths:
            with store.open_input_stream(path) as s:
                for line in _lines(s):
                    row = json.loads(line)
                    if self.wanted(row.get("url")):
                        rows.append({n: row.get(n) for n in _KIND.names})
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=_KIND)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_KIND)


def _lines(stream) -> Iterator[bytes]:
    """The lines of a stream, read in blocks."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x)
    if rest:
        yield rest


def read_site(spark: SparkSession, path: str) -> DataFrame:
    """The stored site under path; comparisons of url are made by the source."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredSite)
    return spark.read.format("gneiss_site").option("path", path).load()


def crawled(pages: DataFrame, start: str, hops: int) -> DataFrame:
    """(url, hop, body) of the pages that links lead to from start within hops, each by its fewest; links to pages that
    the site does not have are dropped. A hop is a join of the new pages' links with the pages."""
    known = written(pages.filter(F.col("url") == start).select("url", F.lit(0).alias("hop")), "crawl")
    for h in range(1, hops + 1):
        out = pages.join(known.filter(F.col("hop") == h - 1).select("url"), "url", "left_semi").select(F.explode("links").alias("url")).distinct()
        new = pages.select("url").distinct().join(out, "url", "left_semi").join(known, "url", "left_anti").withColumn("hop", F.lit(h))
        known = written(known.unionByName(new), "crawl")
    return pages.dropDuplicates(["url"]).join(known, "url").select("url", "hop", "body")
