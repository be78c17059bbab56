"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators between words.
SPACES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests, a local master), a temporary folder is
    set as the checkpoint folder once and used from then on.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, survives lost executors, and gives the planner the true
    size of the table, so that it broadcasts only what is proven small.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more removed now.

    Spark removes them when the driver happens to collect garbage. After a large
    table is written, its shuffles would else lie beside those of the next step.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of a batch of rows that goes to Python at once, unless the session's bound is lower; a single row may be larger.
BATCH = 8 << 20


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` within bounded memory: small batches, and a worker that ends a task hands back what it has freed.

    Workers live on between tasks beside the executor's heap, so memory that they
    keep for later would count for the next stage too.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(key) or "").lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        conf.set(key, str(BATCH))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, all rows after another, and n + 1 offsets.

    A null takes no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Cut a batch so that each part holds ``most`` bytes of text or a single row."""
    _, offsets = raw_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (src, dst: long); root is the smallest node reachable.

    Alternating large and small stars: a logarithmic number of rounds, each a
    map-side combined minimum and an equi-join that adaptive execution can split
    at hub nodes. Every round is a written table.
    """

    def settle(df: DataFrame, small: bool) -> DataFrame:
        both = df.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        if not small:
            both = both.unionByName(df.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u")
        out = (moved.filter("v <> m") if small else moved.filter("v > u")).select(F.col("v").alias("src"), F.col("m").alias("dst"))
        if small:
            out = out.unionByName(least.filter("u <> m").select(F.col("u").alias("src"), F.col("m").alias("dst")))
        return out.distinct()

    mark = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()
    now = materialise(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    was = mark(now)
    while was[0]:
        now = materialise(settle(materialise(settle(now, False)), True))
        if (new := mark(now)) == was:
            break
        was = new
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
