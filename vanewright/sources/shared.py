"""Written tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="vanewright-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode (tests, a laptop), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or own_folder()


_written: list[str] = []
_kept: dict[tuple, object] = {}


def stamp(spark: SparkSession, path: str) -> int:
    """Changes whenever files of a path do: a hash of their names, sizes and times."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return 0
    found, folders = [], [place]
    while folders:
        for f in store.listStatus(folders.pop()):
            if f.isDirectory():
                folders.append(f.getPath())
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def kept_until_removal(f: Callable) -> Callable:
    """Keep what f(spark, sf_dir, *more) returns for later calls of the session, as long as the tables of sf_dir are the
    same and remove_written() hasn't deleted what the result may read."""

    @wraps(f)
    def asked(spark: SparkSession, sf_dir: str, *more):
        key = f.__module__, f.__qualname__, spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir), more
        if key not in _kept:
            _kept[key] = f(spark, sf_dir, *more)
        return _kept[key]

    return asked


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which remove_written() will delete."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lost executors then cost no recomputation, and the size
    that joins see is that of real files."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, label: str, key: str | tuple[str, ...], buckets: int) -> DataFrame:
    """Like written(), as a table bucketed and sorted by a key: tables bucketed alike join on it without a shuffle. The
    frame should come dealt by that key, so that a task writes few buckets."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    columns = [key] if isinstance(key, str) else list(key)
    frame.write.bucketBy(buckets, *columns).sortBy(*columns).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that written() has made in this process, and say how many. To be called once results that
    read them are saved."""
    _kept.clear()
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
