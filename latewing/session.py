"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_SHUFFLE_BYTES_PER_TASK = 128 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int) -> int:
    """Partitions that keep each shuffled piece near 128 MiB, so that tasks fit in memory."""
    return max(8, -(-shuffled_bytes // _SHUFFLE_BYTES_PER_TASK))


def build_session(
    app: str = "latewing", master: str | None = None, shuffled_bytes: int | None = None, **settings
) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    ``shuffled_bytes`` is the largest amount a job is expected to shuffle; it
    sets how many partitions a shuffle starts with (adaptive execution merges
    small ones). Other sizes are left to the cluster unless given, with ``__``
    for the dots of a setting's name.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffled_bytes is not None:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions(shuffled_bytes))
        )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        folder = tempfile.mkdtemp(prefix="latewing-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Stages:
    """Intermediate folders of one piece of work; ``drop`` deletes them when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def drop(self) -> None:
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders.clear()


_OPEN: ContextVar[tuple[Stages, ...]] = ContextVar("open_stages", default=())


@contextmanager
def stages(spark: SparkSession) -> Iterator[Stages]:
    """Collects the folders that are named inside; they outlive it until they are dropped."""
    own = Stages(spark)
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    except BaseException:
        own.drop()
        raise
    finally:
        _OPEN.reset(token)


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for own in _OPEN.get():
        own.folders.append(folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that outlive lost executors. Being a file scan,
    the result carries its true size, so Spark broadcasts it in a join only when
    it is under ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it
    otherwise.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that nobody refers to any more.

    It does so when the driver collects garbage, for which a driver with much memory and little to do may
    not see a reason in hours, while the files of every finished job stay on the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()
