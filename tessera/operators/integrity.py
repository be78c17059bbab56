"""Deduplication, references between entities, the split into valid and quarantined rows, and line items."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sizes import fits, fitted
from ..sources.sinks import write_table
from ..specs import ENTITIES, EntitySpec
from .validation import ERRORS, error, validate


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given total order; rows whose key is null are one group.

    The rank of a group is cut to its first row before the shuffle, so a key that a
    large share of rows has does not gather them in one task.
    """
    spot = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(spot)).filter("_rank = 1").drop("_rank")


def first_places(df: DataFrame, keys: list[str], row: str, path: str) -> DataFrame:
    """``keep_first`` by a column that differs in all rows, for wide tables whose keys seldom repeat.

    Keys that repeat are found from keys and places alone and written to ``path``. Their
    rows are measured, and go to all tasks if they are few; then no row of ``df`` is
    shuffled or sorted. ``df`` is read twice, and its rows have to be the same both times.
    """
    names = [f"_key{k}" for k in range(len(keys))]
    narrow = df.select(*[F.col(f"`{key}`").alias(name) for key, name in zip(keys, names, strict=True)], F.col(row).alias("_first"))
    repeated = narrow.groupBy(*names).agg(F.min("_first").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    repeated = fitted(write_table(repeated, path))
    same = reduce(lambda a, b: a & b, [F.col(f"`{key}`").eqNullSafe(F.col(name)) for key, name in zip(keys, names, strict=True)])
    return df.join(repeated, same, "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col(row))).drop("_first", *names)


def orphans(df: DataFrame, fields: dict[str, DataFrame], out: str = "_orphan", rows: DataFrame | None = None, path: str = "") -> DataFrame:
    """``df`` with an array of errors, one for each field whose value is not among its parent's keys.

    ``fields``: column of ``df`` to a one-column table of keys. Null and empty values are no
    orphans. Keys are compared as strings. Each check is a left join against distinct keys.

    Given ``rows`` and ``path``, keys are measured first, and only those whose rows fit go
    to all tasks. Of more keys, the values that are none of them are found from values and
    keys alone, written to ``path``, and joined instead: they are few as a rule, so the wide
    rows of ``df`` are not shuffled. ``rows`` has all values of ``df``, and maybe others.
    """
    found, bad = [], F.lit(False)
    for k, (name, keys) in enumerate(fields.items()):
        value, key = F.col(f"`{name}`").cast("string"), f"_key{k}"
        keys = keys.select(F.col(keys.columns[0]).cast("string").alias(key)).filter(f"{key} is not null")
        many = rows is not None and not fits(keys)
        keys = keys.distinct()
        if many:
            values = rows.select(value.alias(key)).filter(F.col(key) != "").distinct()
            keys = fitted(write_table(values.join(keys.hint("merge"), key, "left_anti"), f"{path}/{name}"))
        elif rows is not None:
            keys = F.broadcast(keys)
        df = df.join(keys, value == F.col(key), "left")
        lost = value.isNotNull() & (value != "") & (F.col(key).isNotNull() if many else F.col(key).isNull())
        found.append(F.when(lost, error(name, F.col(f"`{name}`"), "referential_integrity", f"{name} has no parent", "parent")))
        bad = bad | F.coalesce(lost, F.lit(False))
    errors = F.when(bad, F.filter(F.array(*found), lambda e: e.isNotNull()).cast(ERRORS)).otherwise(F.array().cast(ERRORS)) if found else F.array().cast(ERRORS)
    return df.withColumn(out, errors).drop(*[f"_key{k}" for k in range(len(fields))])


def judge(df: DataFrame, entity: EntitySpec, parents: dict[str, DataFrame], reference_date: dt.date, rows: DataFrame | None = None, path: str = "") -> DataFrame:
    """``df`` typed and with ``_errors``: broken references, or else the failures of validation; ``_raw`` is null where there are none.

    ``parents``: keys by the name of the entity referred to; references to an entity that is not there are not checked.
    ``rows`` and ``path`` are those of ``orphans``.
    """
    fields = {f: parents[p] for f, p in entity.foreign.items() if p in parents and f in df.columns}
    checked = validate(orphans(df, fields, rows=rows, path=path), entity, reference_date, "_model", F.size("_orphan") > 0)
    return checked.withColumn("_errors", F.when(F.size("_orphan") > 0, F.col("_orphan")).otherwise(F.col("_model"))).drop("_orphan", "_model")


def valid(judged: DataFrame) -> DataFrame:
    """Rows without errors, without the columns of the check."""
    return judged.filter(F.size("_errors") == 0).drop("_errors", "_raw")


def quarantined(judged: DataFrame, row: str = "_row_id") -> DataFrame:
    """(row_index, record, errors) of the other rows."""
    return judged.filter(F.size("_errors") > 0).select(F.col(row).alias("row_index"), F.col("_raw").alias("record"), F.col("_errors").alias("errors"))


def packed(judged: DataFrame) -> DataFrame:
    """``judged`` with the record and the errors as JSON text where there are errors, else null: Parquet writes and reads maps and lists far slower than text."""
    bad = F.size("_errors") > 0
    return judged.withColumns({"_raw": F.when(bad, F.to_json("_raw")), "_errors": F.when(bad, F.to_json("_errors"))})


def sound(table: DataFrame) -> DataFrame:
    """``valid`` of a packed table."""
    return table.filter("_errors is null").drop("_errors", "_raw")


def unpacked(table: DataFrame) -> DataFrame:
    """The rows of a packed table that have errors, as they were."""
    return table.filter("_errors is not null").withColumns({"_raw": F.from_json("_raw", "map<string,string>"), "_errors": F.from_json("_errors", ERRORS)})


ITEM = "array<struct<line_number:string,product_id:string,description:string,quantity:string,unit_cost:string,line_total:string>>"


def line_items(invoices: DataFrame, valid_invoices: DataFrame | None = None, items_col: str = "line_items_json") -> DataFrame:
    """One row for each element of the JSON list of an invoice: invoice_id, the item's fields as strings, its place and lineage.

    Only invoices whose id is among ``valid_invoices`` count. Text that is no JSON list gives nothing.
    """
    if valid_invoices is not None:
        invoices = invoices.join(valid_invoices.select("invoice_id").distinct(), "invoice_id", "left_semi")
    lineage = [c for c in ("_source_file", "_loaded_at") if c in invoices.columns]
    items = invoices.select("invoice_id", *lineage, F.posexplode(F.from_json(items_col, ITEM)).alias("_row_id", "item"))
    return items.select("invoice_id", "item.*", *lineage, F.col("_row_id").cast("long"))


def judge_line_items(items: DataFrame, products: DataFrame | None, reference_date: dt.date, entity: EntitySpec = ENTITIES["invoice_line_item"], rows: DataFrame | None = None, path: str = "") -> DataFrame:
    """Validated first; an item that passes and whose product is unknown is quarantined for that. ``rows`` and ``path`` are those of ``orphans``."""
    fields = {"product_id": products} if products is not None else {}
    checked = validate(orphans(items, fields, rows=rows, path=path), entity, reference_date, "_model", F.size("_orphan") > 0)
    return checked.withColumn("_errors", F.when(F.size("_model") > 0, F.col("_model")).otherwise(F.col("_orphan"))).drop("_orphan", "_model")
