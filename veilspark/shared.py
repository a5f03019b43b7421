"""The folder that driver and executors share, and the intermediate tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of intermediate tables not yet removed: one list for each open scope, the first lasts as long as the driver.
_made: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder already set on the context. Where neither is set, a fresh local folder is set on a local
    master; on a cluster executors would each write to a disk of their own, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="veilspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def workspace(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh path below the shared folder, with its scheme. It is removed when the scope it is made in (or, if ``outer``, the one
    around it) ends, or with the driver."""
    place, system = _path(spark, f"{shared_dir(spark)}/veilspark-{name}-{uuid.uuid4().hex}")
    path = system.makeQualified(place).toString()
    _made[-2 if outer and len(_made) > 1 else -1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back. Lost executors
    then cost a re-read, never a recomputation."""
    path = workspace(df.sparkSession, name, outer)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    place, system = _path(spark, path)
    system.delete(place, True)


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized frame that nothing reads any more."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for made in _made:
        for spark, path in [x for x in made if any(p.endswith(x[1].rsplit("/", 1)[1]) for p in paths)]:
            _remove(spark, path)
            made.remove((spark, path))


@contextmanager
def scope() -> Iterator[None]:
    """Removes at its end the intermediate tables made inside; what outlives it must be written outside or before."""
    _made.append([])
    try:
        yield
    finally:
        for spark, path in _made.pop():
            _remove(spark, path)


@atexit.register
def _clean() -> None:
    for made in _made:
        for spark, path in made:
            try:
                _remove(spark, path)
            except Exception:  # the JVM has gone before
                return
