"""A paged listing, newest id first, as a streaming source: what a crawler's discovery sees of a forum.

write_pages stages a table as numbered page files in the shared folder, with a manifest of their id ranges. The source
reads pages in order, some for each run; its offsets are page numbers, so a stopped run goes on at the page after the
last one that was planned, and a run that is repeated reads the same pages again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gneiss.operators.windows import ranked


def write_pages(posts: DataFrame, id_: str, path: str, size: int) -> None:
    """posts as pages of `size` rows in descending order of id, under path, and their id ranges."""
    placed = ranked(posts, [F.desc(id_)], "_rank").withColumn("page", F.floor((F.col("_rank") - 1) / size)).drop("_rank")
    placed.repartition("page").sortWithinPartitions("page", F.desc(id_)).write.partitionBy("page").parquet(f"{path}/pages")
    placed.groupBy("page").agg(F.min(id_).alias("least"), F.max(id_).alias("most"), F.count("*").alias("rows")).coalesce(1).sortWithinPartitions("page").write.json(f"{path}/manifest")


def _files(path: str, ending: str) -> tuple[fs.FileSystem, list[str]]:
    store, at = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return store, sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name.endswith(ending) and not x.base_name.startswith(("_", ".")))


class Page(InputPartition):
    """One page, and the least id of the page before it."""

    def __init__(self, number: int, before: int | None):
        super().__init__(number)
        self.number, self.before = number, before


class PostPages(DataSource):
    """Format "gneiss_pages"; options path (as write_pages was given), id, pages (for each run, default 10) and state (a
    file in the shared folder that remembers the last page that was planned)."""

    @classmethod
    def name(cls) -> str:
        return "gneiss_pages"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(schema, self.options)


class PageReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.id, self.state = schema, options["path"], options["id"], options["state"]
        self.run = int(options.get("pages", 10))
        self.limit: int | None = None

    def manifest(self) -> list[dict]:
        store, files = _files(f"{self.path}/manifest", ".json")
        rows = []
        for f in files:
            with store.open_input_stream(f) as s:
                rows += [json.loads(x) for x in s.read().decode().splitlines() if x]
        return sorted(rows, key=lambda r: r["page"])

    def planned(self) -> int:
        store, at = fs.FileSystem.from_uri(self.state)
        if store.get_file_info(at).type != fs.FileType.File:
            return 0
        with store.open_input_stream(at) as s:
            return int(s.read().decode() or 0)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        """At most `run` pages past the last one planned; asked again within a run, the same."""
        if self.limit is None:
            self.limit = min(self.planned() + self.run, len(self.manifest()))
        return {"page": self.limit}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        pages = self.manifest()
        for a, b in zip(pages, pages[1:]):
            if b["page"] != a["page"] + 1 or b["most"] >= a["least"]:
                raise ValueError(f"page {b['page']} does not go on below page {a['page']}; offset unchanged")
        store, at = fs.FileSystem.from_uri(self.state)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at) as s:
            s.write(str(max(end["page"], self.planned())).encode())
        return [Page(p["page"], pages[p["page"] - 1]["least"] if p["page"] else None) for p in pages[start["page"] : end["page"]]]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        """The page's rows; ids must fall from row to row and lie below those of the page before."""
        store, files = _files(f"{self.path}/pages/page={partition.number}", ".parquet")
        kind, before = to_arrow_schema(self.schema), partition.before
        for f in files:
            with store.open_input_file(unquote(f) if not store.get_file_info(f).is_file else f) as s:
                for batch in pq.ParquetFile(s).iter_batches(columns=self.schema.names):
                    for i in batch.column(batch.schema.get_field_index(self.id)).to_pylist():
                        if i is None or (before is not None and i >= before):
                            raise ValueError(f"page {partition.number} is not in descending order of ids")
                        before = i
                    yield pa.Table.from_batches([batch]).select(self.schema.names).cast(kind).combine_chunks().to_batches()[0]
