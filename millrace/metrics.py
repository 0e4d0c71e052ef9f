"""Counts and times of what Spark ran, without another pass."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.sources import paths


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows, readable after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextmanager
def timed(into: dict[str, float], name: str) -> Iterator[None]:
    began = time.perf_counter()
    yield
    into[name] = time.perf_counter() - began


def splits(spark: SparkSession, path: str | list[str], most: int = 100) -> list[str]:
    """The first files under the paths, in their order, as readers see them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths(path)).inputFiles()
    return sorted(files)[:most]


@contextmanager
def phases(spark: SparkSession, into: list[dict]) -> Iterator[None]:
    """Adds one entry for each stage that ran in the block: tasks, rows and bytes in and out, what was written to and read from
    the shuffle (with the writers' records and time), spill, the tasks' time and the stage's wall time in ms."""
    group = f"phases-{uuid.uuid4().hex}"
    context = spark.sparkContext
    old = context.getLocalProperty("spark.jobGroup.id")
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        yield
    finally:
        context.setLocalProperty("spark.jobGroup.id", old)
        tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
        ids = sorted({s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds})
        for stage in ids:
            d = store.lastStageAttempt(stage)
            if d.status().toString() != "COMPLETE":
                continue  # its output was there already
            wall = d.completionTime().get().getTime() - d.submissionTime().get().getTime()
            into.append(
                {
                    "stage": stage, "tasks": d.numCompleteTasks(), "rows_in": d.inputRecords(), "bytes_in": d.inputBytes(), "rows_out": d.outputRecords(), "bytes_out": d.outputBytes(),
                    "shuffle_rows_read": d.shuffleReadRecords(), "shuffle_bytes_read": d.shuffleReadBytes(), "shuffle_rows_written": d.shuffleWriteRecords(), "shuffle_bytes_written": d.shuffleWriteBytes(),
                    "shuffle_write_ms": d.shuffleWriteTime() // 1_000_000, "spilled": d.diskBytesSpilled(), "task_ms": d.executorRunTime(), "wall_ms": wall,
                }
            )
