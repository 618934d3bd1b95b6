"""Progress of Spark jobs in per cents of their tasks."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession


class Progress:
    """Calls back with the share of tasks done, of the jobs that run within, whenever it grows; ends with 100."""

    def __init__(self, spark: SparkSession, call, every_s: float = 1.0):
        self.context, self.call, self.every = spark.sparkContext, call, every_s
        self.group, self.done, self.last = uuid.uuid4().hex, threading.Event(), -1

    def percent(self) -> int:
        tracker, all_, ready = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            for stage in getattr(tracker.getJobInfo(job), "stageIds", ()):
                if info := tracker.getStageInfo(stage):
                    all_ += info.numTasks
                    ready += info.numCompletedTasks
        return 100 * ready // all_ if all_ else 0

    def _watch(self) -> None:
        while not self.done.wait(self.every):
            self._tell(self.percent())

    def _tell(self, now: int) -> None:
        if now > self.last:
            self.last = now
            self.call(now)

    def __enter__(self) -> Progress:
        self.before = self.context.getLocalProperty("spark.jobGroup.id")
        self.context.setJobGroup(self.group, "chronobin")
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.done.set()
        self.thread.join()
        self.context.setLocalProperty("spark.jobGroup.id", self.before)
        if kind is None:
            self._tell(100)
