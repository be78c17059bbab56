"""The session that the engine is tuned for."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def side_by_side(spark: SparkSession, tasks: Mapping[str, Callable[[], T]], at_once: int = 4) -> dict[str, T]:
    """The results of tasks that start Spark jobs and don't wait for each other, by name and in their order; the first error is raised.

    Small jobs leave most cores idle, so several run at once.
    """
    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(task)) for name, task in tasks.items()}
        return {name: found.result() for name, found in running.items()}
