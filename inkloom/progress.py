"""Progress of what a session is doing, for a console or a log."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession


def snapshot(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and tasks in all of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


@contextmanager
def reported(spark: SparkSession, report: Callable[[int, int], None], every: float = 1.0):
    """Calls ``report`` with tasks done and tasks in all, every so many seconds while the block runs and something has
    changed. An error in ``report`` ends the reports, not the block."""
    over = threading.Event()

    def watch():
        seen = None
        while not over.wait(every):
            now = snapshot(spark)
            if now != seen and now[1]:
                seen = now
                report(*now)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join(every + 1)
