"""Quality of a normalization: distances and moments before and after; timings of a run."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import rgb_to_lab
from . import stats


def wasserstein(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """First Wasserstein distance of each channel on the unit scale: the mean gap of the dense CDFs."""
    a = stats.cdf(stats.dense(stats.histogram(before, by), by), by)
    b = stats.cdf(stats.dense(stats.histogram(after, by), by), by).withColumnRenamed("cdf", "cdf2")
    return a.join(b, [*by, "ch", "v"]).groupBy(*by, "ch").agg((F.sum(F.abs(F.col("cdf") - F.col("cdf2"))) / 256).alias("wasserstein"))


def channel_qc(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation and distance of each RGB channel; pairs hold r, g, b and r2, g2, b2."""
    both = pairs.select(*by, F.expr("stack(3, 'R', r, r2, 'G', g, g2, 'B', b, b2) as (ch, v, v2)"))
    counts = both.groupBy(*by, "ch", "v", "v2").agg(F.count("*").alias("n"))
    moments = counts.groupBy(*by, "ch").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * e).alias(k) for k, e in (("s", F.col("v")), ("q", F.col("v") * F.col("v")), ("s2", F.col("v2")), ("q2", F.col("v2") * F.col("v2")))))
    dev = lambda s, q: F.sqrt((F.col("n") * F.col(q) - F.col(s) * F.col(s)).cast("double")) / F.col("n")
    moments = moments.select(*by, "ch", (F.col("s") / F.col("n")).alias("orig_mean"), dev("s", "q").alias("orig_std"), (F.col("s2") / F.col("n")).alias("norm_mean"), dev("s2", "q2").alias("norm_std"))
    return moments.join(wasserstein(pairs, pairs.select(*by, *(F.col(f"{c}2").alias(c) for c in "rgb")), by), [*by, "ch"])


def lab_qc(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and deviation of each LAB channel before and after, and the mean absolute difference (``delta_e``)."""
    lab = rgb_to_lab(rgb_to_lab(pairs), ("r2", "g2", "b2"), ("l2_", "a2_", "b2_"))
    long = lab.select(*by, F.expr("stack(3, 'L', l_, l2_, 'a', a_, a2_, 'b', b_, b2_) as (ch, v, v2)"))
    return long.groupBy(*by, "ch").agg(F.avg("v").alias("orig_mean_lab"), F.stddev_pop("v").alias("orig_std_lab"), F.avg("v2").alias("norm_mean_lab"), F.stddev_pop("v2").alias("norm_std_lab"), F.avg(F.abs(F.col("v2") - F.col("v"))).alias("delta_e"))


def timing_report(timings: DataFrame) -> DataFrame:
    """Calls, total, mean and longest of each label, the longest total first."""
    return timings.groupBy("label").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total_s"), (F.avg("seconds") * 1000).alias("mean_ms"), (F.max("seconds") * 1000).alias("max_ms")).orderBy(F.desc("total_s"), "label")


@contextmanager
def no_clock(label: str):
    """The clock of work that nobody times."""
    yield


class _ByLabel(AccumulatorParam):
    """Sums of {label: (calls, total seconds, longest)}."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        for k, (n, s, m) in b.items():
            n0, s0, m0 = a.get(k, (0, 0.0, 0.0))
            a[k] = (n0 + n, s0 + s, max(m0, m))
        return a


class _Clock:
    """What tasks carry: clock("io.load") times a block of code within a task, and the driver gets the sums.

    A task that runs again counts again.
    """

    def __init__(self, held):
        self.held = held

    @contextmanager
    def __call__(self, label: str):
        began = time.perf_counter()
        yield
        spent = time.perf_counter() - began
        self.held.add({label: (1, spent, spent)})


class Timings:
    """Seconds by label, of the driver's steps (``time``) and of work within tasks (``clock``); what raises isn't counted."""

    def __init__(self, spark=None):
        self.rows: list[tuple[str, float]] = []
        self._held = spark.sparkContext.accumulator({}, _ByLabel()) if spark is not None else None
        #: To be used within tasks; without a session it times nothing.
        self.clock = no_clock if spark is None else _Clock(self._held)

    @contextmanager
    def time(self, label: str):
        began = time.perf_counter()
        yield
        self.rows.append((label, time.perf_counter() - began))

    def clear(self) -> None:
        self.rows.clear()
        if self._held is not None:
            self._held.value = {}

    @property
    def tasks(self) -> dict[str, tuple[int, float, float]]:
        """Calls, total and longest of each label timed within tasks."""
        return dict(self._held.value) if self._held is not None else {}

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "label string, seconds double")

    def summary(self, spark) -> DataFrame:
        """The columns of ``timing_report``, over the driver's steps and what tasks timed."""
        sums = [(k, n, s, s / n * 1000, m * 1000) for k, (n, s, m) in self.tasks.items()]
        held = spark.createDataFrame(sums, "label string, calls long, total_s double, mean_ms double, max_ms double")
        return timing_report(self.frame(spark)).unionByName(held).orderBy(F.desc("total_s"), "label")

    def report(self, spark) -> str:
        rows = self.summary(spark).collect()
        lines = [f"{r['label']:<24} {r['calls']:>6} calls  {r['total_s']:>9.3f} s  mean {r['mean_ms']:>9.2f} ms  max {r['max_ms']:>9.2f} ms" for r in rows]
        return "\n".join(lines) or "No timings recorded."
