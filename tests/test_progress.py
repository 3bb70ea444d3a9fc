"""What a tracker is told while Spark works."""

import threading

import pytest
from pyspark.sql import functions as F

from gridlark.sources.progress import StatusTracker


def test_tasks_of_a_section(spark):
    tracker = StatusTracker("x")
    slow = F.udf(lambda x: __import__("time").sleep(0.15) or x, "long")
    with tracker.task("whole"), tracker.watching(spark, 0.05):
        tracker.section("first")
        spark.range(0, 24, 1, 24).select(slow("id").alias("id")).write.format("noop").mode("overwrite").save()
        tracker.section("second")
        assert spark.range(0, 1000, 1, 7).groupBy((F.col("id") % 3).alias("k")).count().count() == 3
    tasks = [e for e in tracker.events if e.what == "tasks"]
    first = [e for e in tasks if e.section == "first"]
    assert (first[-1].done, first[-1].maximum) == (24, 24)
    # it was looked at on its way, and never went back
    assert len({e.done for e in first}) > 2 and [e.done for e in first] == sorted(e.done for e in first)
    second = [e for e in tasks if e.section == "second"]
    assert second[-1].done == second[-1].maximum >= 8


def test_other_threads_and_failures_are_left_alone(spark):
    tracker = StatusTracker("x")
    with tracker.watching(spark, 0.05):
        other = threading.Thread(target=lambda: spark.range(0, 10, 1, 5).count())
        other.start()
        other.join()
    assert [e for e in tracker.events if e.done] == []
    with pytest.raises(ValueError), tracker.watching(spark, 0.05):
        raise ValueError
    assert not list(spark.sparkContext.getJobTags())


def test_rows_are_counted_on_their_way(spark):
    tracker = StatusTracker("x")
    tracker.section("read")
    tracker.counted(spark.range(0, 1234, 1, 3), "rows").write.format("noop").mode("overwrite").save()
    tracker.settle()
    tracker.settle()
    assert tracker.events == [("read", "rows", 1234, 1234)]
