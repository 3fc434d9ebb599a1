"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session."""
    master = master or os.environ.get("FLOWSENTRY_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName("flowsentry")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _checkpoint_conf(spark: SparkSession) -> str | None:
    for getter in (lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir"),
                   lambda: spark.conf.get("spark.checkpoint.dir", None)):
        try:
            v = getter()
        except Exception:  # pragma: no cover - conf not present
            v = None
        if v:
            return v
    return None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is read from the session and never overridden. Only in a
    local session without it (tests) a fresh folder is created and registered.
    """
    d = _checkpoint_conf(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="flowsentry-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared folder for an intermediate table; what is
    written there goes when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/flowsentry/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return folder + "/data"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts lineage at a point that survives lost executors, and gives the
    optimizer true sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def concurrently(spark: SparkSession, *jobs, threads: int = 6) -> list:
    """The results of independent ``jobs`` (functions without arguments) whose Spark jobs run side
    by side: each has a thread that inherits the session's properties, and a scheduler pool of
    its own where the scheduler is fair. The first error is raised after all have ended."""
    def pooled(number, job):
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"flowsentry-{number}")
            return job()
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(pooled(i, job)) for i, job in enumerate(jobs)]]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowsentry`` importable on executors (pandas functions pickle
    references to its modules): zip the package once per application and
    hand it to ``SparkContext.addPyFile``, which distributes it to every
    executor's Python path."""
    import zipfile

    import flowsentry
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(flowsentry.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="flowsentry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
