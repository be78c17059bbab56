"""Bronze as a stream: new files of a folder, once each, with lineage. Records have the columns of the given schema, not flattened, and no place: a stream has no last file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_source(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The records of the folder's files with their file and the time of loading."""
    df = spark.readStream.format(fmt).schema(schema).options(**options).load(folder)
    return df.select("*", F.col("_metadata.file_name").alias("_source_file"), F.current_timestamp().cast("string").alias("_loaded_at"))


def deduplicated(df: DataFrame, keys: list[str], time_col: str, delay: str = "1 day") -> DataFrame:
    """The first record of each key; state older than ``delay`` is dropped."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def ingest_available(df: DataFrame, table_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Write all files that are there and not yet read to a Parquet table, and end."""
    return df.writeStream.format("parquet").option("path", table_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
