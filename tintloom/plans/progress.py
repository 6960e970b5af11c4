"""Watching a run from another thread: how far it came, and ending it.

A run that is watched takes its slides in waves. Its jobs are of one group, so that cancelling ends those that run; the
slides of the wave that was under way are cancelled and leave no file, those before are finished, and those after were
never started. Giving files their final names isn't interrupted.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CANCELLED, UNSTARTED = "cancelled", "not started"


class Watch:
    """Given to ``pipeline.run``. wave: slides that are written at a time."""

    def __init__(self, spark: SparkSession, wave: int = 16):
        self.spark, self.wave = spark, wave
        self.group = f"tintloom-{uuid.uuid4().hex}"
        self.total = self.done = 0
        self._stop = threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def cancel(self) -> None:
        """End the run as soon as may be; from any thread."""
        self._stop.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    @contextmanager
    def jobs(self, what: str):
        """Jobs of this thread are the run's."""
        context = self.spark.sparkContext
        context.setJobGroup(self.group, what, interruptOnCancel=True)
        try:
            yield
        finally:
            self._free()

    def _free(self) -> None:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.spark.sparkContext.setLocalProperty(key, None)

    @contextmanager
    def spared(self):
        """Jobs that cancelling leaves alone."""
        self._free()
        try:
            yield
        finally:
            self.spark.sparkContext.setJobGroup(self.group, "normalize", interruptOnCancel=True)

    def progress(self) -> dict[str, int]:
        """Slides finished and in all, and tasks finished and in all of the jobs that run now."""
        tracker, tasks, ready = self.spark.sparkContext.statusTracker(), 0, 0
        for job in set(tracker.getJobIdsForGroup(self.group)) & set(tracker.getActiveJobsIds()):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                at = tracker.getStageInfo(stage)
                if at:
                    tasks, ready = tasks + at.numTasks, ready + at.numCompletedTasks
        return {"slides": self.total, "slides_done": self.done, "tasks": tasks, "tasks_done": ready}


class Background:
    """A function of a watch in a thread of its own: ``pipeline.run`` beside what else the driver does."""

    def __init__(self, watch: Watch, work: Callable[[Watch], DataFrame]):
        self.watch, self._result, self._error = watch, None, None

        def go():
            try:
                self._result = work(watch)
            except BaseException as e:
                self._error = e

        self._thread = threading.Thread(target=go, daemon=True)
        self._thread.start()

    def result(self, timeout: float | None = None) -> DataFrame:
        """Waits for the run's log; raises what the run raised."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the run goes on")
        if self._error is not None:
            raise self._error
        return self._result
