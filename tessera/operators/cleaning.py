"""Cleaning by rules, which have a name and are either built in or compiled from a description."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..specs import EntitySpec

log = logging.getLogger(__name__)
Rule = Callable[[Column], Column]

#: Descriptions of the rules that are built in.
BUILT_IN = {
    "lowercase": {"type": "case", "case": "lower"},
    "uppercase": {"type": "case", "case": "upper"},
    "titlecase": {"type": "case", "case": "title"},
    "phone_normalize": {"type": "phone"},
    "boolean_normalize": {"type": "boolean"},
    "date_iso": {"type": "date"},
    "trim": {"type": "string", "operations": ["trim", "normalize_whitespace"]},
    "strip": {"type": "string", "operations": ["trim"]},
    "collapse_whitespace": {"type": "string", "operations": ["normalize_whitespace"]},
}
_CASES = {"lower": S.lowercase, "upper": S.uppercase, "title": S.titlecase}
_OPERATIONS = {"trim": S.strip, "normalize_whitespace": S.collapse}


def compile_rule(rule: Mapping | None, reference_date: dt.date | None = None) -> Rule | None:
    """The expression that a description stands for; None if it stands for none.

    Types: ``case`` (lower, upper or title), ``phone``, ``boolean``, ``date``, and
    ``string`` with a list of operations, trim and normalize_whitespace, which are
    done in that order. Operations of other names do nothing.
    """
    kind = (rule or {}).get("type")
    if kind == "case":
        return _CASES.get(rule.get("case", "lower"))
    if kind == "phone":
        return S.phone
    if kind == "boolean":
        return S.boolean
    if kind == "date":
        return (lambda c: S.date_iso(c, reference_date)) if reference_date else S.date_iso
    if kind == "string":
        steps = [f for name, f in _OPERATIONS.items() if name in (rule.get("operations") or [])]
        if steps:
            return lambda c: reduce(lambda done, f: f(done), steps, c)
    return None


class SilverCleaner:
    """Cleaning rules by name, compiled from their descriptions (``cleaners`` of a rules file, or the built-in ones)."""

    def __init__(self, cleaning_rules: Mapping | None = None, reference_date: dt.date | None = None) -> None:
        described = BUILT_IN if cleaning_rules is None else cleaning_rules.get("cleaners") or {}
        self.dates = {name for name, d in described.items() if (d or {}).get("type") == "date"}
        self.rules = {name: rule for name, d in described.items() if (rule := compile_rule(d, reference_date)) is not None}

    def applies(self, df: DataFrame, name: str, rule: str | None) -> bool:
        """Whether the rule is known and the column there and a string."""
        if rule and rule not in self.rules:
            log.warning("%s: no cleaning rule %r", name, rule)
        return rule in self.rules and name in df.columns and isinstance(df.schema[name].dataType, T.StringType)

    def clean_column(self, df: DataFrame, field_name: str, rule_name: str) -> tuple[DataFrame, bool]:
        """(table, whether the rule applied). Unknown rules, missing columns and columns that aren't strings change nothing."""
        if not self.applies(df, field_name, rule_name):
            return df, False
        return df.withColumn(field_name, self.rules[rule_name](F.col(f"`{field_name}`"))), True

    def unread_dates(self, df: DataFrame, entity: EntitySpec) -> dict[str, Column]:
        """For each column with a rule for dates: whether a cell has a form that only the Arrow function may read."""
        cells = {f.name: F.col(f"`{f.name}`") for f in entity.fields if f.clean in self.dates and self.applies(df, f.name, f.clean)}
        return {name: S.native_date(c).isNull() & (c != "") for name, c in cells.items()}

    def clean(self, df: DataFrame, entity: EntitySpec, read: frozenset[str] = frozenset()) -> tuple[DataFrame, list[str]]:
        """All of an entity's rules in one projection; also the columns they applied to. Dates in the columns ``read`` have known forms, so no row passes Python for them."""
        todo = [f for f in entity.fields if f.clean and self.applies(df, f.name, f.clean)]
        rule = lambda f: (lambda c: S.date_iso(c, fallback=False)) if f.name in read else self.rules[f.clean]
        return df.withColumns({f.name: rule(f)(F.col(f"`{f.name}`")) for f in todo}), [f.name for f in todo]


def clean_column(df: DataFrame, name: str, rule: str, reference_date: dt.date | None = None) -> tuple[DataFrame, bool]:
    """(table, whether the built-in rule applied)."""
    return SilverCleaner(None, reference_date).clean_column(df, name, rule)


def clean(df: DataFrame, entity: EntitySpec, reference_date: dt.date | None = None) -> tuple[DataFrame, list[str]]:
    """All of an entity's rules, built in, in one projection; also the columns they applied to."""
    return SilverCleaner(None, reference_date).clean(df, entity)
