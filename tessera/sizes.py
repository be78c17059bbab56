"""Which side of a join goes to all tasks, by the memory that its rows take.

Spark guesses the rows of a scan from the bytes of its files. Keys in compressed
columns take 30 to 100 times as much once they are rows in a table of hashes, which
the driver makes before it sends it. So a guess may be below Spark's limit for a
table that does not fit into the driver. Sides are measured here instead.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

_LOCK = threading.Lock()
#: How many are inside of ``measured_joins``, and what was set before, by session.
_INSIDE: WeakKeyDictionary[SparkSession, tuple[int, dict[str, str | None]]] = WeakKeyDictionary()


def limit(spark: SparkSession) -> int:
    """The most bytes of rows that the session sends to all tasks for a join; below 0 if it sends none."""
    text = spark.conf.get(MEASURED, None) or spark.conf.get(GUESSED)
    return -1 if text.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def _row_bytes(table: DataFrame) -> Column:
    """A row as Spark holds it in memory: a word of null bits and one for each column, and texts in whole words."""
    out = F.lit(8 * (1 + len(table.columns))).cast("long")
    for f in table.schema:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            out = out + F.coalesce(F.ceil(F.octet_length(F.col(f"`{f.name}`")) / 8) * 8, F.lit(0))
    return out


def fits(table: DataFrame) -> bool:
    """Whether the rows of a table of plain columns take less than the session sends to all tasks; one pass over it."""
    found = table.agg(F.coalesce(F.sum(_row_bytes(table)), F.lit(0)).alias("n")).first()["n"]
    return found <= limit(table.sparkSession)


def fitted(table: DataFrame) -> DataFrame:
    """A written table, with the hint that its rows ask for: sent to all tasks if they fit, else joined by a shuffle."""
    return F.broadcast(table) if fits(table) else table.hint("merge")


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, adaptive execution alone decides which sides go to all tasks, from the rows that it has shuffled.

    The settings are the session's, so they hold for all its threads until the last one is out.
    """
    with _LOCK:
        inside, before = _INSIDE.get(spark, (0, {}))
        if not inside:
            before = {key: spark.conf.get(key, None) for key in (GUESSED, MEASURED)}
            spark.conf.set(MEASURED, before[MEASURED] or spark.conf.get(GUESSED))
            spark.conf.set(GUESSED, "-1")
        _INSIDE[spark] = inside + 1, before
    try:
        yield
    finally:
        with _LOCK:
            inside, before = _INSIDE.pop(spark)
            if inside > 1:
                _INSIDE[spark] = inside - 1, before
            else:
                for key, value in before.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)
