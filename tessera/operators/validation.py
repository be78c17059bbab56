"""Validation: each field's coercion and rules as columns, failures as an array of structs."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import email_or_null, lax_int, native_date, not_future, snake, strip, unit_interval
from ..specs import SPARK_TYPES, EntitySpec, FieldSpec

ERROR = "struct<field:string,value:string,target:string,type:string,msg:string>"
ERRORS = f"array<{ERROR}>"


def error(field: Column | str, value: Column, kind: Column | str, msg: Column | str, target: Column | str | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(field).alias("field"), value.cast("string").alias("value"), as_col(target).cast("string").alias("target"), as_col(kind).alias("type"), as_col(msg).alias("msg")).cast(ERROR)


def typed(c: Column, kind: str, native: T.DataType) -> tuple[Column, Column]:
    """(value, type of the error or null) of a cell for a declared type."""
    text, nothing = isinstance(native, T.StringType | T.NullType), F.lit(None).cast("string")
    if kind == "integer":
        value = lax_int(c.cast("string"))
        bad = F.lit("int_parsing") if text else F.lit("int_from_float")
    elif kind == "float":
        value, bad = c.try_cast("double"), F.lit("float_parsing")
    elif kind == "boolean":
        if isinstance(native, T.BooleanType):
            return c, nothing
        low = F.lower(c.cast("string"))
        value, bad = F.when(low.isin("true", "t", "yes", "y", "on", "1"), True).when(low.isin("false", "f", "no", "n", "off", "0"), False), F.lit("bool_parsing")
    else:
        return (c.cast("string"), nothing) if text else (c.cast("string"), F.when(c.isNotNull(), F.lit("string_type")))
    return value, F.when(c.isNotNull() & value.isNull(), bad)


def rule(f: FieldSpec, raw: Column, native: T.DataType, reference_date: dt.date) -> tuple[Column, Column, Column]:
    """(validated value, error struct or null, whether there is one) of one field; at most one error, the first that applies."""
    value, bad = typed(raw, f.type, native)
    fail = lambda kind, msg: error(f.name, raw, kind, msg)
    checks: list[tuple[Column, Column]] = []
    if f.required:
        checks.append((raw.isNull(), fail("missing", "field required")))
    checks.append((bad.isNotNull(), error(f.name, raw, bad, F.concat(F.lit("not a valid "), F.lit(f.type)))))
    if f.pattern:
        checks.append((~value.rlike(rf"\A{f.pattern}\z"), fail("string_pattern_mismatch", f"does not match {f.pattern}")))
    nan = F.isnan(value) if f.type == "float" else F.lit(False)
    if f.lo is not None:
        # A value that is no number fails the last bound.
        checks.append(((value < f.lo) & ~nan if f.hi is not None else (value < f.lo) | nan, fail("greater_than_equal", f"below {f.lo}")))
    if f.hi is not None:
        checks.append(((value > f.hi) | nan, fail("less_than_equal", f"above {f.hi}")))
    if f.not_blank:
        checks.append((strip(value) == "", fail("value_error", f"{f.name} cannot be empty")))
    if f.transform == "not_future":
        checks.append((value.isNotNull() & native_date(value).isNull(), fail("value_error", "not a date")))
    value = {"email": email_or_null, "snake": snake, "unit_interval": unit_interval}.get(f.transform, lambda c: c)(value)
    if f.transform == "not_future":
        value = not_future(value, reference_date)
    chain = reduce(lambda made, check: made.when(*check), checks[1:], F.when(*checks[0]))
    return value, chain, reduce(lambda found, check: found | F.coalesce(check[0], F.lit(False)), checks, F.lit(False))


def validate(df: DataFrame, entity: EntitySpec, reference_date: dt.date, out: str = "_errors", also_raw: Column | None = None) -> DataFrame:
    """``df`` with the entity's columns typed, missing ones added as null, and the array of errors.

    Declared columns come first, in the entity's order; lineage and other columns
    whose name starts with ``_`` follow, the rest is dropped. ``_raw`` keeps the
    record as it came, as a map of strings; given ``also_raw``, only of rows that have
    errors or for which it holds. Errors are made for rows that have some alone: Spark
    does not compile functions over arrays.
    """
    have = {f.name: f.dataType for f in df.schema}
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in have if c[0] != "_"]), F.array(*[F.col(f"`{c}`").cast("string") for c in have if c[0] != "_"]))
    values, errors, bad = [], [], F.lit(False)
    for f in entity.fields:
        cell = F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast("string")
        value, err, failed = rule(f, cell, have.get(f.name, T.StringType()), reference_date)
        values.append(value.cast(SPARK_TYPES[f.type]).alias(f.name))
        errors.append(err)
        bad = bad | failed
    found = F.when(bad, F.filter(F.array(*errors), lambda e: e.isNotNull()).cast(ERRORS)).otherwise(F.array().cast(ERRORS))
    if also_raw is not None:
        raw = F.when(bad | also_raw, raw)
    return df.select(*values, *[c for c in have if c[0] == "_"], raw.alias("_raw"), found.alias(out))


def histogram(errors: DataFrame, column: str = "_errors") -> DataFrame:
    """(type, n): errors by type, the most frequent first; a record with several broken references counts once."""
    kinds = F.array_union(F.transform(F.filter(column, lambda e: e["type"] == "referential_integrity"), lambda e: e["type"]), F.array().cast("array<string>"))
    others = F.transform(F.filter(column, lambda e: e["type"] != "referential_integrity"), lambda e: e["type"])
    return errors.select(F.explode(F.concat(others, kinds)).alias("type")).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")
