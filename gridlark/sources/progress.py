"""Progress of long tasks, through logging: sections of a task, Spark's own tasks while they
run, and rows that went through a pass."""

from __future__ import annotations

import contextlib
import logging
import threading
import time
import uuid
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Event(NamedTuple):
    """What a section had done of `what` (`tasks` of Spark, or rows by their name) when it
    was looked at; rows are known only once they are through, so both are their number."""

    section: str
    what: str
    done: int
    maximum: int


class StatusTracker:
    """Sections, progress and times of a task."""

    def __init__(self, name: str, level: int = logging.INFO):
        self.name, self.progress, self.maximum = name, 0, 1
        self.sections: list[tuple[str, float]] = []
        self.events: list[Event] = []
        self._seen: list[tuple[str, str, Observation]] = []
        self._log = logging.getLogger(f"gridlark.{name}")
        self._level, self._begun = level, 0.0

    def set_maximum(self, n: int) -> None:
        self.maximum, self.progress = n, 0

    def increment(self, n: int = 1) -> None:
        self.progress = min(self.maximum, self.progress + n)

    def section(self, text: str) -> None:
        self.sections.append((text, time.monotonic()))
        self._log.log(self._level, "%s: %s", self.name, text)

    @property
    def elapsed(self) -> float:
        return time.monotonic() - self._begun

    @contextlib.contextmanager
    def task(self, text: str) -> Iterator[StatusTracker]:
        self._begun = time.monotonic()
        self.section(text)
        try:
            yield self
        except Exception:
            self._log.error("%s: %s failed after %.1f s", self.name, text, self.elapsed)
            raise
        self.progress = self.maximum
        self._log.log(self._level, "%s: %s took %.1f s", self.name, text, self.elapsed)

    def _now(self) -> str:
        return self.sections[-1][0] if self.sections else ""

    def _record(self, event: Event) -> None:
        self.events.append(event)
        self._log.log(self._level, "%s: %s: %d of %d %s", self.name, event.section, event.done, event.maximum, event.what)

    def counted(self, df: DataFrame, what: str = "lines") -> DataFrame:
        """The same rows; the action that goes through them counts them on its way, and
        `settle` records the number. A stage that runs again for lost executors may count
        rows twice, so this is for showing."""
        seen = Observation(f"{what}-{uuid.uuid4().hex}")
        self._seen.append((self._now(), what, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def settle(self) -> None:
        """Records counts of `counted`, whose actions have to be over."""
        for section, what, seen in self._seen:
            n = seen.get["n"]
            self._record(Event(section, what, n, n))
        self._seen.clear()

    @contextlib.contextmanager
    def watching(self, spark: SparkSession, seconds: float = 0.5) -> Iterator[StatusTracker]:
        """Follows the tasks of the jobs that this thread starts in the block: an event
        whenever a look finds more done or more to do in the present section. Stages that
        Spark skips, as their results are there, do not count."""
        sc, tag, over = spark.sparkContext, f"gridlark-{uuid.uuid4().hex}", threading.Event()
        status, jobs = sc._jsc.sc().statusTracker(), sc.statusTracker()
        before: dict[int, tuple[int, int]] = {}
        at: dict[str, dict[int, tuple[int, int]]] = {}

        def look() -> bool:
            """Records what is new; whether a job runs."""
            runs, section = False, self._now()
            for job in [job for job in status.getJobIdsForTag(tag)]:
                info = jobs.getJobInfo(job)
                if info is None:
                    continue
                mine = info.status == "RUNNING"
                runs |= mine
                for stage in info.stageIds:
                    state = jobs.getStageInfo(stage)
                    if state is not None:
                        before[stage] = (state.numCompletedTasks, state.numTasks if mine else state.numCompletedTasks)
                        # a stage belongs to the section in which it was first seen
                        if not any(stage in stages for stages in at.values()):
                            at.setdefault(section, {})[stage] = before[stage]
            for name, stages in at.items():
                fresh = {stage: before[stage] for stage in stages}
                sums = [tuple(map(sum, zip(*x.values(), strict=True))) for x in (fresh, stages)]
                if sums[0] != sums[1] or not any(e.section == name and e.what == "tasks" for e in self.events):
                    self._record(Event(name, "tasks", *sums[0]))
                stages.update(fresh)
            return runs

        def follow() -> None:
            while not over.wait(seconds):
                with contextlib.suppress(Exception):  # a look that fails, as at the end of a session, stops no work
                    look()

        sc.addJobTag(tag)
        thread = threading.Thread(target=follow, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            over.set()
            thread.join()
            sc.removeJobTag(tag)
            # what listeners know lags behind the work: looked at until nothing is new
            end, known = time.monotonic() + 5, -1
            while (look() or known != len(self.events)) and time.monotonic() < end:
                known = len(self.events)
                time.sleep(0.15)
