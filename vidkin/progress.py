"""Progress and stop of long actions."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Stopped(Exception):
    """The action was stopped before its end."""


def watched(spark: SparkSession, action: Callable[[], T], progress: Callable[[int, int], None] | None = None, stop: threading.Event | None = None, every: float = 0.5) -> T:
    """action(), run in a tag of its own. progress gets the tasks done and known of its jobs now and then; once stop is
    set its jobs are cancelled and Stopped is raised."""
    sc, tag, ended = spark.sparkContext, f"vidkin-{uuid.uuid4().hex}", threading.Event()

    def look() -> None:
        tracker = sc.statusTracker()
        while not ended.wait(every):
            if stop is not None and stop.is_set():
                sc.cancelJobsWithTag(tag)
            if progress is not None:
                jobs = [j for j in map(tracker.getJobInfo, sc._jsc.sc().statusTracker().getJobIdsForTag(tag)) if j]
                stages = [s for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s]
                progress(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))

    watcher = threading.Thread(target=look, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        if stop is not None and stop.is_set():
            raise Stopped
        return action()
    except Stopped:
        raise
    except Exception as e:
        if stop is not None and stop.is_set():
            raise Stopped from e
        raise
    finally:
        ended.set()
        watcher.join()
        sc.removeJobTag(tag)
