"""Sinks: Parquet between layers, CSV and JSON at the edge."""

from __future__ import annotations

import shutil
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How many bytes are copied at once.
_COPIED = 8 << 20
#: How many characters of a text deal rows with one place in the order to ranges.
_DEALT = 64


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors both reach it: under ``spark.checkpoint.dir``, or a temporary one on a local master that has none."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite the table and read it back; an empty table is written too, so nothing stale stays."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header, as a folder of part files. A compressed file is read by one task, a plain one may be split."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', compression=compression).csv(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    """JSON lines of {row_index, record, errors}; null values of a record stay."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, order: str = "row_index") -> None:
    """One JSON file that holds the rows as an array, in the given order and then by their text; an empty table gives an empty array.

    Rows are sorted by ranges into parts, and one task copies the bytes of the parts
    behind each other: one file can't be written by several. So no task holds more
    than its range. ``path`` is a ``file:`` path or of a store that pyarrow knows.
    ``write_quarantine`` is the form without the copy.
    """
    spark = df.sparkSession
    text = df.select(F.col(order).alias("at"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    # The driver draws a sample of what deals the rows, so that is a text's start, which orders rows as far as it goes.
    ranges = text.repartitionByRange("at", F.substring("value", 1, _DEALT)).sortWithinPartitions("at", "value")
    ranges.select(F.concat("value", F.lit(",")).alias("value")).write.mode("overwrite").text(folder := f"{path}._parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # Files are named by the number of their range.
    found = sorted((f.getPath().getName(), f.getLen()) for f in files.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("part-") and f.getLen())
    whole = spark.range(1).coalesce(1).mapInArrow(_framed(files.makeQualified(hadoop.Path(folder)).toString(), found), "name string").first()["name"]
    files.delete(place, True)
    files.rename(hadoop.Path(f"{folder}/{whole}"), place)
    files.delete(hadoop.Path(folder), True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _framed(folder: str, parts: list[tuple[str, int]]):
    """Copies the parts, (name, bytes), whose lines end in a comma, into one array beside them, and gives its name, which is the attempt's own."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            store, top = opened(folder)
            name = f"_whole-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(b"[")
                for k, (part, size) in enumerate(parts):
                    with store.open_input_stream(f"{top}/{part}") as read:
                        if k < len(parts) - 1:
                            shutil.copyfileobj(read, out, _COPIED)
                            continue
                        # The last comma and line feed are not copied.
                        size -= 2
                        while size:
                            out.write(data := read.read(min(size, _COPIED)))
                            size -= len(data)
                out.write(b"]\n")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in whichever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
