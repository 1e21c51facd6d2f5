"""The shared folder, scratch tables in it, and cutting the lineage of iterative operators."""

from __future__ import annotations

import atexit
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths of each application, in the order in which they were made.
_scratch: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Local sessions without one get a temporary folder; a cluster has to name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder.  It goes with its :func:`scope`, with :func:`release`, or when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(_delete, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _scratch[app])
    _scratch[app].append(path)
    return path


#: Paths that :func:`once` has made, by application and name.
_made: dict[tuple[str, str], str] = {}


def once(spark: SparkSession, name: str, make: Callable[[], str]) -> str:
    """The scratch path that ``make`` wrote under ``name``; it is called again only if that path has been released."""
    app = spark.sparkContext.applicationId
    path = _made.get((app, name))
    if path is None or path not in _scratch.get(app, []):
        path = _made[app, name] = make()
    return path


def _delete(jvm, conf, paths: list[str]) -> None:
    """Delete ``paths`` and forget them."""
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, once results have been read."""
    _delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _scratch.get(spark.sparkContext.applicationId, []))


def discard(df: DataFrame) -> None:
    """Delete the table that ``df`` was stored as, if it was."""
    made = _scratch.get(df.sparkSession.sparkContext.applicationId, [])
    if (path := getattr(df, "scratch", None)) in made:
        made.remove(path)
        _delete(df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), [path])


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables made inside go at the end, but for those that are passed to what this yields.

    Whatever is read from afterwards has to be kept or stored.
    """
    app = spark.sparkContext.applicationId
    start, kept = len(_scratch.get(app, [])), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch)
        return df

    try:
        yield keep
    finally:
        made = _scratch.get(app, [])
        gone = [p for p in made[start:] if p not in kept]
        made[start:] = [p for p in made[start:] if p in kept]
        _delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), gone)


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than a reread.  ``files`` bounds
    their number, for tables that are known to be small.
    """
    path = scratch_path(df.sparkSession, label)
    if files is not None:
        df = df.coalesce(files)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let shuffle files go that no plan needs: Spark deletes them when the driver collects its garbage, which a long run may not do for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder; its plan runs once, where a checkpoint would run it twice."""
    return stored(df, "cut")


#: Rows of a table that one task hands to a Python function, about.
PYTHON_ROWS = 1 << 14


def spread(df: DataFrame, rows: int = PYTHON_ROWS) -> DataFrame:
    """``df``, a table of small rows, over tasks by their number: a few files, or one row group, would be a few tasks, however slow what follows is."""
    return df.repartition(max(1, math.ceil(df.count() / rows)))


def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """``df`` from a table in the shared folder that is bucketed by a column, so that joins and groups on it shuffle no row of it.

    The catalog's entry goes at once; the plan keeps the folder and the buckets.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "dealt")
    name = "tessera_" + uuid.uuid4().hex
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out.scratch = path
    return out
