"""Session helpers: settings a job needs, and the shared folder it may write to."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidecast", cpus: str = "*", shuffle_partitions: int = 8):
    """A local session for tests and benchmarks. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Generated methods above this size are not compiled by the JVM; run them in parts.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder on this machine; anywhere else a
    missing setting is an error, because executors would not see the files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's own folder below the shared one.

    The folder goes when the driver's Python ends: results are lazy, so what they read
    must stay as long as anyone may ask for them.
    """
    top = f"{shared_dir(spark)}/tidecast-{spark.sparkContext.applicationId}"
    if top not in _OWN:
        _OWN.add(top)
        atexit.register(drop_folder, spark, top)
    return f"{top}/{label}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage it lies; nothing happens once Spark is gone."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives a lost executor, gives the passes that follow a
    columnar input instead of a recomputation, and tells the planner the true size: a
    small table is broadcast under Spark's own threshold, a large one is joined by
    shuffle, without a hint that would hold only for today's data.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def together(*jobs: Callable) -> list:
    """Run jobs that do not need each other at once, each from a thread of its own.

    A small batch spends its time on planning and committing one job after another; side by
    side, the cluster is the same and the waiting is shared. The first error is raised when
    all have ended.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def landed_together(**frames: DataFrame) -> list[DataFrame]:
    """``landed`` for several frames that do not read each other, in the order given."""
    return together(*[lambda df=df, name=name: landed(df, name) for name, df in frames.items()])
