"""Progress and cancellation of an analysis: its jobs carry a tag."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the running jobs of a tag; other analyses go on."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> dict[int, tuple[int, int]]:
    """Of each active stage the finished and all tasks."""
    tracker = spark.sparkContext.statusTracker()
    stages = {s: tracker.getStageInfo(s) for s in tracker.getActiveStageIds()}
    return {s: (i.numCompletedTasks, i.numTasks) for s, i in stages.items() if i}
