"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, for functions that run in Python there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "gneiss_functions.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for d, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def tasks(spark: SparkSession) -> int:
    """How many tasks a costly step is dealt to."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt anew before a step that costs much for each row: a small file is one task, however many rows it holds, and
    adaptive execution joins small partitions, whatever is made of their rows."""
    return df.repartition(tasks(df.sparkSession), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of this session's own, which only a local master can use."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("gneiss.local.shared", None)
        if not found:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = f"file://{tempfile.mkdtemp(prefix='gneiss-shared-')}"
            spark.conf.set("gneiss.local.shared", found)
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that go when the application ends."""
    path = f"{shared_dir(spark)}/gneiss/{name}-{uuid.uuid4().hex}"
    _store(spark, path).deleteOnExit(_path(spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: reading it needs neither df's plan nor the executors that made it.
    The table goes with dropped(), at the latest when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _store(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gneiss/" in folder:
            _store(spark, folder).delete(_path(spark, folder), True)
