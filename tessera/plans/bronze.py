"""Bronze: every source as a flat Parquet table with lineage."""

from __future__ import annotations

import datetime as dt
import logging
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..session import side_by_side
from ..sources.reader import read_source, with_lineage
from ..sources.sinks import export_csv, write_table
from ..specs import SOURCES, SourceSpec

log = logging.getLogger(__name__)


class BronzeIngester:
    """Reads the sources of ``input_dir`` and writes a table for each under ``output_dir``."""

    def __init__(self, spark: SparkSession, input_dir: str, output_dir: str, sources: tuple[SourceSpec, ...] = SOURCES, csv: bool = False) -> None:
        self.spark, self.input_dir, self.output_dir, self.sources, self.csv = spark, input_dir, output_dir, sources, csv

    def ingest(self, spec: SourceSpec, loaded_at: dt.datetime | None = None) -> DataFrame:
        return with_lineage(read_source(self.spark, spec, self.input_dir), spec.file, loaded_at or dt.datetime.now())

    def ingest_all(self) -> dict[str, dict]:
        """A result for each source; one that fails does not stop the others."""
        now = dt.datetime.now()

        def one(spec: SourceSpec) -> dict:
            try:
                df = write_table(self.ingest(spec, now), f"{self.output_dir}/{spec.name}")
                if self.csv:
                    export_csv(df, f"{self.output_dir}_csv/{spec.name}")
                return {"success": True, "row_count": df.count(), "source_file": spec.file, "format": spec.format, "columns": [c for c in df.columns if c != "_row_id"]}
            except Exception as e:
                log.warning("%s: %s", spec.name, e)
                return {"success": False, "error": str(e), "source_file": spec.file, "format": spec.format}

        return side_by_side(self.spark, {spec.name: partial(one, spec) for spec in self.sources})
