"""Flat tables from records of JSON, whose shape may differ from record to record.

A record's values are Spark's VARIANT, so each record decides for itself: an object
of plain values gives ``key_child`` columns, any other object or list gives its text
under ``key``, and so does a plain value or null. A key that is an object in some
records and null in others therefore has its own column beside its children's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import ROW

_MAP = "map<string,variant>"
#: Kinds of values, and what a column of one kind is; numbers of both kinds are doubles, and other mixtures strings.
_TYPES = {frozenset({"BIGINT"}): "bigint", frozenset({"DOUBLE"}): "double", frozenset({"BIGINT", "DOUBLE"}): "double", frozenset({"BOOLEAN"}): "boolean"}


def _shape(v: Column) -> Column:
    """The schema of a value, without quoted names."""
    return F.regexp_replace(F.schema_of_variant(v), "`([^`]|``)*`", "")


def _plain_object(shape: Column) -> Column:
    return F.startswith(shape, F.lit("OBJECT<")) & ~F.substring(shape, 8, 1 << 30).rlike("OBJECT<|ARRAY<")


def _kind(shape: Column) -> Column:
    return F.when(shape.rlike("^(OBJECT|ARRAY)<"), "JSON").when(F.startswith(shape, F.lit("DECIMAL")) | (shape == "FLOAT"), "DOUBLE").when(shape.isin("BIGINT", "DOUBLE", "BOOLEAN", "VOID"), shape).otherwise("STRING")


def _children(v: Column) -> Column:
    return F.try_variant_get(v, "$", _MAP)


def _columns(values: DataFrame) -> list[tuple[str, str | None, frozenset[str]]]:
    """(key, child or None, kinds of its values) of each column, in the order in which they first appear.

    One row for each column and kind comes to the driver.
    """
    entries = values.select("_at", F.posexplode(F.map_entries("_map")).alias("_pos", "_entry")).select("_at", "_pos", "_entry.key", "_entry.value", _shape(F.col("_entry.value")).alias("shape"))
    own = entries.select("_at", "_pos", "key", F.when(_plain_object(F.col("shape")), F.map_entries(_children(F.col("value")))).alias("children"), "shape")
    spot = lambda child, kind, place: F.struct(child.cast("string").alias("child"), kind.alias("kind"), place.cast("int").alias("place"))
    listed = F.when(F.col("children").isNull(), F.array(spot(F.lit(None), _kind(F.col("shape")), F.lit(0)))).otherwise(F.transform("children", lambda c, k: spot(c["key"], _kind(_shape(c["value"])), k)))
    # A record has a column once, so the spot of the first record is that of the column. Whole numbers let Spark aggregate by hash, where structs would be sorted.
    spots = own.select("_at", "key", "_pos", F.explode(listed).alias("c")).select("_at", "key", "c.child", "c.kind", (F.col("_pos").cast("long") * (1 << 31) + F.col("c.place")).alias("_spot"))
    found = spots.groupBy("key", "child", "kind").agg(F.struct(F.min("_at"), F.min_by("_spot", "_at")).alias("first")).collect()
    kinds: dict[tuple, set] = {}
    for r in sorted(found, key=lambda r: tuple(r["first"])):
        kinds.setdefault((r["key"], r["child"]), set()).add(r["kind"])
    return [(key, child, frozenset(k)) for (key, child), k in kinds.items()]


def _cell(v: Column, kinds: frozenset[str], guard: Column | None) -> tuple[Column, str]:
    """(value, type) of a column; where ``guard`` does not hold it is null."""
    kind = _TYPES.get(kinds - {"VOID"}, "string")
    cell = F.try_variant_get(v, "$", kind)
    return (cell if guard is None else F.when(guard, cell)), kind


def flatten_records(texts: DataFrame, text_col: str = "value", row_col: str = ROW) -> DataFrame:
    """A flat table with a row for each text, which is a JSON object, and the columns that its values need, in the order of their first appearance.

    Columns hold whole numbers, doubles, booleans or strings; nested values stand as
    JSON text. Records without a key have null there. Where a child's column has the
    name of another key, the first one's value counts and the other's where it is
    null, as strings. Objects without keys give no column. Text that is no object
    makes the query fail. All other columns than the text stay.
    """
    parsed = F.from_json(text_col, _MAP, {"mode": "FAILFAST"})
    values = texts.withColumn("_map", parsed).withColumn("_at", F.col(row_col))
    found = _columns(values.select("_map", "_at"))
    shapes: dict[str, set] = {}
    for key, child, kinds in found:
        shapes.setdefault(key, set()).update({"CHILD"} if child is not None else kinds)
    made: dict[str, list[tuple[Column, str]]] = {}
    for key, child, kinds in found:
        v = F.try_element_at("_map", F.lit(key))
        simple = _plain_object(_shape(v))
        if child is None:
            made.setdefault(key, []).append(_cell(v, kinds, ~simple if "CHILD" in shapes[key] else None))
        else:
            made.setdefault(f"{key}_{child}", []).append(_cell(F.try_element_at(_children(v), F.lit(child)), kinds, simple if "JSON" in shapes[key] else None))
    kept = [c for c in texts.columns if c != text_col]
    one = lambda cells: cells[0][0] if len(cells) == 1 else F.coalesce(*[c.cast("string") for c, _ in cells])
    return values.select(*[one(cells).alias(name) for name, cells in made.items() if name not in kept], *kept)
