"""One place that maps job settings to Spark configuration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_TRUE = {"1", "true", "yes", "on"}
_SHARED = "spark.checkpoint.dir"


def truthy(value: str | None) -> bool:
    """``1``, ``true``, ``yes`` and ``on`` in any case are true; all else, and absence, is false."""
    return (value or "").strip().lower() in _TRUE


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share. Where that is unset, a local run
    gets a temporary one; on a cluster that is an error, as a machine's own folder is not seen by the others."""
    base = spark.conf.get(_SHARED, None) or spark.sparkContext.getConf().get(_SHARED)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_SHARED} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_SHARED, base)
    return base.rstrip("/")


def session(app: str = "millrace", master: str | None = None, reducers: int | None = None, threads: int | None = None, log_level: str = "WARN", s3_attempts: int = 3, s3_wait_ms: int = 200, **conf: str) -> SparkSession:
    """A session with UTC times, ANSI arithmetic and adaptive execution.

    ``master`` is left to spark-submit where it is None and one is set. ``reducers`` is the count of shuffle partitions of
    the whole job; MILLRACE_REDUCERS stands in for it, and without either Spark's default holds and AQE coalesces. ``threads``
    (or MILLRACE_THREADS) are the cores of a local master, or of each executor of a cluster. A read from S3 is tried
    ``s3_attempts`` times, at first after ``s3_wait_ms``. Shuffle buffers are Spark's own (``spark.shuffle.file.buffer`` and
    others, by ``conf``).
    """
    builder = SparkSession.builder.appName(app)
    threads = threads or int(os.environ.get("MILLRACE_THREADS", "0"))
    if threads and (master or "local").startswith("local") and not (master or "").startswith("local-cluster"):
        master = f"local[{threads}]" if master in (None, "local") or master.startswith("local[") else master
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.hadoop.fs.s3a.attempts.maximum": str(s3_attempts),
        "spark.hadoop.fs.s3a.retry.limit": str(s3_attempts),
        "spark.hadoop.fs.s3a.retry.interval": f"{s3_wait_ms}ms",
    }
    reducers = reducers or int(os.environ.get("MILLRACE_REDUCERS", "0"))
    if reducers:
        settings["spark.sql.shuffle.partitions"] = str(reducers)
    if threads and master and not master.startswith("local"):
        settings["spark.executor.cores"] = str(threads)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark
