"""The place of a record among all records of a source: files by path, and within a file from its start.

Spark splits files among tasks and packs the splits by size, so neither the number of
a task nor that of a row in it follows the files. A scan knows the file and the start
of the split that a row comes from, and rows of a split come in order. So splits are
counted once, and a record's place is the count of the splits before plus its number
in its own. Places are 0, 1, 2 ... however the files are split.
"""

from __future__ import annotations

import threading

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The place of a record in its source, the total order behind "first".
ROW = "_row_id"

_LOCK = threading.Lock()


def keep_splits(spark: SparkSession) -> None:
    """Lets Spark cut files alike in every pass of this session, also if executors come or go between two passes.

    The size of splits follows the number of cores at the time that a plan runs, unless
    ``spark.sql.files.minPartitionNum`` is set. If it is not, it becomes the number that
    Spark would take now, and stays so, as plans read it when they run.
    """
    key = "spark.sql.files.minPartitionNum"
    with _LOCK:
        if not spark.conf.get(key, None):
            spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))


def with_place(scan: DataFrame, out: str = ROW) -> DataFrame:
    """``scan``, a table just read from files, with the place of each row.

    Splits are counted at once, by a pass that reads no column. That pass and the later
    one are of one and the same scan, whose splits Spark cuts and packs alike each time.
    """
    keep_splits(scan.sparkSession)
    marked = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_number"))
    return numbered(marked, out)


def numbered(marked: DataFrame, out: str = ROW) -> DataFrame:
    """``marked`` without its columns _file, _block and _number (consecutive in a split, from anywhere), and with the place.

    The driver sees a row for each split, as in the listing of the files. Spark knows
    the size of that table, so it sends it to all tasks only if it is small.
    """
    splits = marked.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_number").alias("_least")).toPandas()
    splits = splits.sort_values(["_file", "_block"], ignore_index=True)
    splits["_shift"] = splits["_rows"].cumsum() - splits["_rows"] - splits["_least"]
    # An Arrow table becomes a local relation, whose size Spark knows, whatever the session says about Arrow; a pandas one may not.
    names = {"_file": pa.string(), "_block": pa.int64(), "_shift": pa.int64()}
    starts = marked.sparkSession.createDataFrame(pa.table({n: pa.array(splits[n], t) for n, t in names.items()}))
    kept = [F.col(f"`{c}`") for c in marked.columns if c not in ("_file", "_block", "_number")]
    return marked.join(starts, ["_file", "_block"]).select(*kept, (F.col("_number") + F.col("_shift")).alias(out))
