"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "glosa") -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling switched on.

    On a cluster the master and resources come from spark-submit; ``master`` is
    only for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = (b.config("spark.driver.host", "127.0.0.1")
                 .config("spark.driver.bindAddress", "127.0.0.1")
                 .config("spark.driver.memory", os.environ.get("GLOSA_DRIVER_MEMORY", f"{_half_memory_gb()}g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (b.config("spark.ui.enabled", "false")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _half_memory_gb() -> int:
    """Half of the machine's memory, 16 GB at most: Python workers need the rest."""
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 2**30
    return max(1, min(16, total // 2))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (shared storage on a cluster).

    Only a local-mode session without the setting gets a scratch folder of its
    own; a cluster session without it is an error, because a machine-local
    folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running glosa jobs")
        d = tempfile.mkdtemp(prefix="glosa-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() or d).rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write's shuffle files go when it ends, and not when the driver happens to collect garbage:
    what it wrote is read from then on."""
    known, before = False, None
    try:
        known, before = spark.conf.isModifiable(CLEANUP), spark.conf.get(CLEANUP, None)
        if known:
            spark.conf.set(CLEANUP, "true")
        yield
    finally:
        if known and before is None:
            spark.conf.unset(CLEANUP)
        elif known:
            spark.conf.set(CLEANUP, before)


_COPIES: list[list[str]] = []  # of the open ``copies_dropped``


@contextmanager
def copies_dropped(spark: SparkSession) -> Iterator[None]:
    """What ``cut_lineage`` stores meanwhile goes at the end: for copies that nothing reads once their results are stored."""
    own: list[str] = []
    _COPIES.append(own)
    try:
        yield
    finally:
        _COPIES.remove(own)
        for path in own:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written once to the shared folder as Parquet and read back: its encodings keep the copy
    far smaller than a checkpoint's rows (a vector table by more than ten times). The shuffles
    behind it are not kept."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _COPIES:
        _COPIES[-1].append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def right_size(df: DataFrame, n_rows: int, row_bytes: int, target_bytes: int = 64 * 1024 * 1024,
               work: int = 0, target_work: int = 200_000_000) -> DataFrame:
    """At most ``ceil(rows × row bytes / target)`` partitions, or as many cores as the
    work of a pass (operations a row × rows) keeps busy.

    Iterative fits launch one job per iteration, so a small training set in many
    partitions pays the task overhead many times over: it is coalesced (no
    shuffle). A large one keeps the splits its scan already has — they are
    sized by ``spark.sql.files.maxPartitionBytes`` — rather than being
    shuffled into new ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, -(-n_rows * row_bytes // target_bytes), min(cores, -(-n_rows * work // target_work))))
