"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Semaphore
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def run_together(tasks: Sequence[Callable[[], T]], parallelism: int) -> list[T]:
    """Results in task order.  Each thread carries the caller's local properties (job group, pool)."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
        futures = [pool.submit(inherit(task)) for task in tasks]
        return [f.result() for f in futures]


class Gate:
    """A bound on the tasks that run at a time, shared by all threads that hold it, however they are nested."""

    def __init__(self, limit: int):
        self._free = Semaphore(max(1, limit))

    def through(self, task: Callable[..., T]) -> Callable[..., T]:
        """``task``, waiting for its turn, and its ``many`` if it has one.  It must not call another task of the same gate."""
        def run(*args, **kwargs) -> T:
            with self._free:
                return task(*args, **kwargs)

        if hasattr(task, "many"):
            run.many = self.through(task.many)
        return run
