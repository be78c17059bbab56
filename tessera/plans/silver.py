"""Silver: clean, deduplicate, check references, validate, and split into valid and quarantined rows."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import SilverCleaner
from ..operators.integrity import first_places, judge, judge_line_items, keep_first, line_items, packed, quarantined, sound, unpacked
from ..operators.validation import histogram
from ..session import side_by_side
from ..sources.reader import ROW, exists
from ..sources.sinks import export_csv, write_json_array, write_quarantine, write_table
from ..specs import ENTITIES, SOURCES, EntitySpec, SourceSpec, levels

log = logging.getLogger(__name__)

#: The JSON list of an invoice's items as it came, which stays beside the judged invoice.
ITEMS = "_items"
#: The share of rows that repeat a key, from which on all rows are shuffled to find the first of each key.
REPEATED = 0.1


@dataclass
class ProcessingResult:
    source: str
    schema: str = ""
    total: int = 0
    valid: int = 0
    quarantined: int = 0
    duplicates_removed: int = 0
    orphaned: int = 0
    cleaned: list[str] = field(default_factory=list)
    errors: dict[str, int] = field(default_factory=dict)
    quarantine_path: str = ""

    @property
    def pass_rate(self) -> float:
        """Valid rows over all rows read, duplicates included."""
        return self.valid / self.total if self.total else 0.0


class SilverProcessor:
    """Reads the Bronze tables and writes ``silver`` and ``quarantine`` tables.

    Sources run in the order of their references, those that don't wait for each other side by side. A check against an entity that
    has no valid rows, or that is not among the sources, is left out. The output
    of each source is written once and read back by what follows, so that no
    lineage is computed twice.

    ``entities`` and ``rules`` take the place of the built-in schemas and cleaning
    rules; they may come from files (``load_schemas``, ``load_rules``).
    """

    def __init__(self, spark: SparkSession, bronze_dir: str, output_dir: str, quarantine_dir: str, sources: tuple[SourceSpec, ...] = SOURCES, reference_date: dt.date = dt.date(2026, 2, 1), csv: bool = False, entities: dict[str, EntitySpec] = ENTITIES, rules: dict | None = None, quarantine_array: bool = False) -> None:
        self.spark, self.bronze_dir, self.output_dir, self.quarantine_dir = spark, bronze_dir, output_dir, quarantine_dir
        self.sources, self.reference_date, self.csv = sources, reference_date, csv
        self.entities, self.cleaner, self.quarantine_array = entities, SilverCleaner(rules, reference_date), quarantine_array
        self.keys: dict[str, DataFrame] = {}

    def process_all(self) -> dict[str, ProcessingResult]:
        results: dict[str, ProcessingResult] = {}
        for level in levels(self.sources, self.entities):
            results |= side_by_side(self.spark, {s.name: partial(self.process, s) for s in level})
        if (found := self.process_line_items()) is not None:
            results["invoice_line_items"] = found
        return results

    def process(self, source: SourceSpec) -> ProcessingResult:
        result, path = ProcessingResult(source.name, source.schema), f"{self.bronze_dir}/{source.name}"
        if not exists(self.spark, path):
            log.warning("%s: no Bronze table", source.name)
            return result
        raw = self.spark.read.parquet(path)
        entity = self.entities.get(source.schema)
        if entity is None:
            result.total = result.valid = write_table(raw, f"{self.output_dir}/{source.name}").count()
            return result
        kept = raw.withColumn(ITEMS, F.col("line_items_json")) if self._has_items(source, raw) else raw
        # One pass steers the way: whether keys repeat often, and whether dates need Python. All ways give the same rows.
        unread = self.cleaner.unread_dates(raw, entity)
        keys = F.approx_count_distinct(F.col(f"`{entity.key}`"), 0.02) if entity.key in raw.columns else F.lit(0)
        result.total, distinct, *left = raw.agg(F.count("*"), keys, *[F.count_if(c) for c in unread.values()]).first()
        df, result.cleaned = self.cleaner.clean(kept, entity, frozenset(name for name, n in zip(unread, left, strict=True) if not n))
        rows = df
        if entity.key in df.columns:
            if distinct < (1 - REPEATED) * result.total:
                df = keep_first(df, [entity.key], [ROW])
            else:
                df = first_places(df, [entity.key], ROW, f"{self.output_dir}/_repeated/{source.name}")
        self._finish(judge(df, entity, self.keys, self.reference_date, rows, f"{self.output_dir}/_lost/{source.name}"), source.name, result)
        result.duplicates_removed = result.total - result.valid - result.quarantined
        if result.valid:
            self.keys[entity.name] = self.spark.read.parquet(f"{self.output_dir}/{source.name}").select(entity.key)
        return result

    @staticmethod
    def _has_items(source: SourceSpec, bronze: DataFrame) -> bool:
        return source.name == "invoices" and "line_items_json" in bronze.columns

    def _finish(self, judged: DataFrame, name: str, result: ProcessingResult, placed: bool = True) -> None:
        judged = write_table(packed(judged), f"{self.output_dir}/_judged/{name}")
        wrong = unpacked(judged)
        good = sound(judged).drop(ITEMS).withColumnsRenamed({"_source_file": "source_file", "_loaded_at": "loaded_at"})
        # The place in the source stays: what follows takes first and last rows by it.
        good = good.select(*[c for c in good.columns if c != ROW], *[c for c in good.columns if c == ROW and placed])
        good = write_table(good, f"{self.output_dir}/{name}")
        result.quarantine_path = f"{self.quarantine_dir}/{name}"
        (write_json_array if self.quarantine_array else write_quarantine)(quarantined(wrong), result.quarantine_path)
        if self.csv:
            export_csv(good.drop(ROW), f"{self.output_dir}_csv/{name}")
        lost = F.exists("_errors", lambda e: e["type"] == "referential_integrity")
        result.valid, (result.quarantined, result.orphaned) = good.count(), wrong.agg(F.count("*"), F.count_if(lost)).first()
        result.errors = {r["type"]: r["n"] for r in histogram(wrong).collect()}

    def process_line_items(self) -> ProcessingResult | None:
        """Items of the JSON lists of the valid invoices, each invoice once; None if there are no such lists."""
        path = f"{self.output_dir}/_judged/invoices"
        if "invoice" not in self.keys or not exists(self.spark, f"{self.bronze_dir}/invoices") or not exists(self.spark, path):
            return None
        judged = self.spark.read.parquet(path)
        if ITEMS not in judged.columns:
            return None
        # Judged invoices are there once, and their lists stand beside them.
        items = line_items(sound(judged), items_col=ITEMS)
        result = ProcessingResult("invoice_line_items", "invoice_line_item")
        entity = self.entities.get("invoice_line_item", ENTITIES["invoice_line_item"])
        self._finish(judge_line_items(items, self.keys.get("product"), self.reference_date, entity, items, f"{self.output_dir}/_lost/invoice_line_items"), "invoice_line_items", result, placed=False)
        result.total = result.valid + result.quarantined
        return result
