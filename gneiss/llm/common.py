"""What the corpus operators share: tables, shared folders, Arrow row mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.shared import shared_dir, written

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Texts in one Arrow batch; with long texts a batch stays at some tens of MB.
BATCH_ROWS = 250
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Gives executors this package (once per application) and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(), "gneiss.zip")
    root = os.path.dirname(PACKAGE)
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


#: A key is hot if it has more than one in this many of all rows, so that there are fewer hot keys than this.
HOT_ONE_IN = 1000


def hot_join(rows: DataFrame, named: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with named (one row for each value of keys), without sending all rows of a hot value to one task.

    named[count] is how many of rows have the value. The values with more than 1/HOT_ONE_IN of all counted rows, which
    are fewer than HOT_ONE_IN, are broadcast; only the other rows are shuffled. how is inner or left; keys are not null.
    """
    total = named.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(count) * HOT_ONE_IN > F.lit(total)
    few = named.filter(hot).drop(count)
    marks = F.broadcast(few.select(*keys))
    usual = rows.join(marks, keys, "left_anti").join(named.filter(~hot).drop(count), keys, how)
    return usual.unionByName(rows.join(F.broadcast(few), keys))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later steps neither recompute df nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def positional(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with every column but those of keep named by its place, so that no name meets one that an operator uses."""
    return docs.toDF(*(c if c in keep else f"gneiss_column_{i}" for i, c in enumerate(docs.columns)))


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists: fn gets one batch's columns and returns those of its result."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    return df.mapInArrow(lean(run), schema)


def filter_batches(df: DataFrame, keep: Callable[[dict[str, list]], list[bool]]) -> DataFrame:
    """The rows of df for which keep (given one batch's text column as a list) says so, with all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep({"text": b.column(b.schema.get_field_index("text")).to_pylist()}), pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


_LOADED: dict[str, object] = {}
_USED: set[str] = set()


def once(key: str, make: Callable[[], object]) -> object:
    """One object per Python worker and key, kept across tasks as long as they use it."""
    _USED.add(key)
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run as a task's function, after which the worker gives up the objects of once() that it did not use: workers are
    reused, and the tables of one operator should not stay in memory while another one runs."""

    def task(batches: Iterator) -> Iterator:
        _USED.clear()
        yield from run(batches)
        unused = [k for k in _LOADED if k not in _USED]
        for k in unused:
            del _LOADED[k]
        if unused:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


__all__ = ["cut", "filter_batches", "hot_join", "lean", "map_batches", "once", "positional", "prepare", "shared_dir", "table", "text_or_empty", "written"]
