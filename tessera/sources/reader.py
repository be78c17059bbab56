"""Scans: CSV, JSON and Parquet to flat tables with lineage."""

from __future__ import annotations

import datetime as dt
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..specs import SourceSpec
from .places import ROW, with_place
from .records import flatten_records
from .split_csv import csv_records
from .split_json import json_records

_NESTED = (T.StructType, T.ArrayType, T.MapType)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its file system, whichever that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """All columns as strings; doubled quotes and quoted empty cells are kept, and so are quoted line breaks if ``multiline``.

    Files are split among tasks either way. The first file's header names the columns.
    """
    options = {"escape": '"', "emptyValue": ""}
    if not multiline:
        return with_place(spark.read.options(header=True, **options).csv(path))
    files = sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    headed = (spark.read.options(header=True, multiLine=True, **options).csv(unquote(f)).schema for f in files)
    schema = next((s for s in headed if len(s)), T.StructType())
    if not len(schema):
        return spark.createDataFrame([], f"{ROW} long")
    cells = F.from_csv("value", _ddl(schema), {"multiLine": "true", **options})
    return csv_records(spark, path).select(cells.alias("r"), ROW).select("r.*", ROW)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def read_json(spark: SparkSession, path: str, data_key: str | None = None) -> DataFrame:
    """Flat records of JSON documents: a bare list, or an object with a list under ``data_key`` or, without a key, the first list in it.

    A document is split among tasks. A missing key or an empty list gives a table without rows.
    """
    return flatten_records(json_records(spark, path, data_key))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Flat records, one for each line that is not blank."""
    lines = with_place(spark.read.text(path))
    return flatten_records(lines.filter(F.trim("value") != ""))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_place(spark.read.parquet(path))


def flatten(df: DataFrame) -> DataFrame:
    """A struct of plain fields becomes ``parent_child`` columns; other structs, arrays and maps become JSON text.

    Decided by the schema, so every row has the same columns. Where names clash,
    the column that the table has already stays.
    """
    taken, out = {f.name for f in df.schema}, []
    for f in df.schema:
        c: Column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType) and not any(isinstance(g.dataType, _NESTED) for g in f.dataType):
            out += [c.getField(g.name).alias(f"{f.name}_{g.name}") for g in f.dataType if f"{f.name}_{g.name}" not in taken]
        else:
            out.append((F.to_json(c) if isinstance(f.dataType, _NESTED) else c).alias(f.name))
    return df.select(*out)


def with_lineage(df: DataFrame, file: str, loaded_at: dt.datetime | str) -> DataFrame:
    return df.withColumns({"_source_file": F.lit(file), "_loaded_at": F.lit(loaded_at if isinstance(loaded_at, str) else loaded_at.isoformat())})


READERS = {
    "csv": lambda spark, path, spec: read_csv(spark, path, spec.multiline),
    "json": lambda spark, path, spec: read_json(spark, path, spec.data_key),
    "jsonl": lambda spark, path, spec: read_json_lines(spark, path),
    "parquet": lambda spark, path, spec: read_parquet(spark, path),
}


def read_source(spark: SparkSession, spec: SourceSpec, input_dir: str) -> DataFrame:
    """The flat records of a source; FileNotFoundError if its file is missing, ValueError if its format is unknown."""
    path = f"{input_dir}/{spec.file}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if spec.format not in READERS:
        raise ValueError(f"unknown format: {spec.format}")
    return flatten(READERS[spec.format](spark, path, spec))
