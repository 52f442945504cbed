"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests), one of our own for this application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="marlspark-")
    return _own_dirs[context.applicationId]


def bounded(spark: SparkSession, most: str = "4m") -> None:
    """Bound Arrow batches by bytes, unless the session has a bound already: rows can be long, so that their number bounds nothing."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def _store(spark: SparkSession, path: str):
    """The path and the file system that has it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. The JVM removes it when the application ends, where drop() hasn't before."""
    where, store = _store(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    store.deleteOnExit(where)
    # with its scheme, also where the setting has none: Spark and Files must mean the same store
    return store.makeQualified(where).toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: cuts the lineage and fixes the rows against recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove materialized tables, or folders, that nothing reads any more."""
    for t in tables:
        where, store = _store(spark, t if isinstance(t, str) else t.stored_at)
        store.delete(where, True)
        store.cancelDeleteOnExit(where)
