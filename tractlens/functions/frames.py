"""Frames that a driver loop reads many times: partitions from counted rows, pooled jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame

from tractlens.functions.stats import materialize_small

#: Rows of a training partition: enough to outweigh a task's start, and up to ``MOST`` where
#: all cores have work already.
LEAST_ROWS, MOST_ROWS = 2_000, 200_000


def training_frame(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, cached, in partitions sized by its rows.

    A model family runs hundreds of small jobs over it.  The plan before it is cut, so that
    none of them plans it again, and a panel of a thousand rows isn't spread over 200 tasks."""
    done = materialize_small(df)
    return partitioned(done, done.count())


def partitioned(done: DataFrame, rows: int) -> DataFrame:
    """A written frame of ``rows`` rows, cached in the partitions of a training frame."""
    cores = done.sparkSession.sparkContext.defaultParallelism
    # Whole waves: as many tasks for every core.
    parts = max(1, min(-(-rows // LEAST_ROWS), cores * max(1, -(-rows // (cores * MOST_ROWS)))))
    return done.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)


def pooled(jobs: Iterable[Callable[[], object]], threads: int = 4) -> list:
    """Results of independent driver-side jobs, in order; Spark runs up to ``threads`` of them at once."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(lambda job: job()), list(jobs), chunksize=1)
