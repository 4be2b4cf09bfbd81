"""Tables written in the folder that the cluster shares, and numbers of partitions."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode (tests) a temporary one where that is unset."""
    where = spark.conf.get(SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        where = getattr(spark, "_larder_dir", None)
        if not where:
            where = spark._larder_dir = "file://" + tempfile.mkdtemp(prefix="larder-")
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return
    if path.startswith("file:"):  # the session has ended
        shutil.rmtree(urllib.parse.urlparse(path).path, ignore_errors=True)


class Scope:
    """Owns the stages and broadcasts that are made while it is active; `close` deletes them, once their results are written."""

    now: Scope | None = None

    def __init__(self) -> None:
        self.stages: list[Stage] = []
        self.broadcasts: list[Broadcast] = []

    @contextlib.contextmanager
    def active(self) -> Iterator[None]:
        before, Scope.now = Scope.now, self
        try:
            yield
        finally:
            Scope.now = before

    def close(self) -> None:
        for s in self.stages:
            _delete(s.spark, s.root)
        for b in self.broadcasts:
            with contextlib.suppress(Exception):  # the session has ended
                b.destroy()
        self.stages, self.broadcasts = [], []


def send(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of something of bounded size."""
    b = spark.sparkContext.broadcast(value)
    if Scope.now is not None:
        Scope.now.broadcasts.append(b)
    return b


class Stage:
    """A folder of one query's intermediate tables.  Lost executors reread them; nothing is recomputed.

    Folders go when the program ends, or with the scope that owns them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/larder/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)
        if Scope.now is not None:
            Scope.now.stages.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt anew where the input has fewer splits than the cluster has cores (small or single-block files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of an input, from file sizes."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return 0


def partitions_for(df: DataFrame, mb: int = 16) -> int:
    """Shuffle partitions of about `mb` of input each, no fewer than the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, min(1_000_000, math.ceil(size / (mb << 20))) if size < 1 << 60 else least)
