"""Session settings and reliable checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "larder", **settings: str) -> SparkSession:
    """A session with adaptive plans, UTC and Arrow; more settings by name with __ for dots."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _unset(spark: SparkSession) -> str:
    """A temporary folder, in local mode only: on a cluster other machines would not see it."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    where = getattr(spark, "_larder_folder", None)
    if not where:
        where = spark._larder_folder = "file://" + tempfile.mkdtemp(prefix="larder-shared-")
    return where


_folders: list[str] = []  # made by this program and not yet deleted


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares; in local mode below a temporary one where none is set.

    It goes when the program ends, or with `release`.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or _unset(spark)
    path = f"{where.rstrip('/')}/larder/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(release)
    _folders.append(path)
    return path


def release(since: int = 0) -> None:
    """Deletes the intermediate folders made since there were `since` of them (`len(_folders)`); nothing may read them any more."""
    from larder.sources.files import filesystem

    while len(_folders) > since:
        with contextlib.suppress(Exception):  # nothing was written, or it has gone with the folder above
            system, place = filesystem(_folders[-1])
            system.delete_dir(place)
        _folders.pop()


@contextlib.contextmanager
def intermediates():
    """What is made inside goes at the end: for programs that run many queries and have written their results."""
    since = len(_folders)
    try:
        yield
    finally:
        release(since)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder in spark.checkpoint.dir; in local mode to a temporary one where that is unset."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where or _unset(spark) + "/checkpoints")
    return df.checkpoint()


def dealt(df: DataFrame, mb: int = 32) -> DataFrame:
    """The rows of an input too small to be read by every core (by Spark's estimate of its size), dealt to all of them: for costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * mb << 20 else df


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to a new shared folder and read from there (a checkpoint makes its rows twice)."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
