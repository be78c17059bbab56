"""CSV whose cells may hold line breaks, read by many tasks.

Whether a line starts a record depends on the quotes of all lines before it. Quotes
that are doubled or paired leave the state as it is, so a line only matters by
whether its number of quotes is odd, and splits can be looked at side by side: a
first pass gives each split's parity and how many records start in it from either
state, sums over the splits give the state at each split's start, and a second pass
cuts the records. Those that a split's edge runs through are put together at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import ROW, keep_splits

_SUMMARY = "file long, block long, odd int, plain long, quoted long"
_PIECES = "row long, split long, whole boolean, value string"


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(value, file, block): the pieces of the files between separators, in order within each split; ``file`` is a digest of the path."""
    keep_splits(spark)
    found = spark.read.option("recursiveFileLookup", True).text(path, lineSep=separator)
    return found.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("path"))


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """((file, block), values) for stretches of one split in batches of (value, file, block)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(k).to_numpy() for k in (1, 2))
        edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield (int(file[a]), int(block[a])), batch.column(0).slice(a, b - a)


def _looked_at(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(quotes before each line and after the last, modulo 2; whether a line is not blank)."""
    odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
    full = pc.utf8_length(values).to_numpy(zero_copy_only=False) > 0
    return np.append(0, np.cumsum(odd)) & 1, full & ~pc.equal(values, "\r").to_numpy(zero_copy_only=False)


def _summaries(batches):
    """A row for each split, or for each task's share of it."""
    now, odd, starts = None, 0, [0, 0]
    for split, values in by_split(batches):
        if split != now:
            if now:
                yield _summary(now, odd, starts)
            now, odd, starts = split, 0, [0, 0]
        state, full = _looked_at(values)
        for quoted in (0, 1):
            starts[quoted] += int((full & ((state[:-1] ^ odd) == quoted)).sum())
        odd ^= int(state[-1])
    if now:
        yield _summary(now, odd, starts)


def _summary(split, odd, starts) -> pa.RecordBatch:
    cells = (*split, odd, *starts)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["file", "block", "odd", "plain", "quoted"])


def splits_of(pieces: DataFrame, summaries: DataFrame):
    """The summaries of all splits as a pandas table in the order of the files' paths and the splits.

    One row for each split comes to the driver, as in the listing of the files.
    """
    paths = pieces.select("file", "path").distinct().toPandas()
    if paths["file"].duplicated().any():
        raise ValueError("two paths have one digest")
    found = summaries.toPandas().merge(paths, on="file")
    return found.sort_values(["path", "block"], ignore_index=True)


def _cut(splits: dict[str, np.ndarray], header: bool):
    """Records of each split from its state at the start; a header's number is that of the file's first record less 1, and it is left out."""
    where = {key: k for k, key in enumerate(zip(splits["file"].tolist(), splits["block"].tolist(), strict=True))}

    def run(batches):
        # ``held``: lines of a record that isn't cut yet, which may come over several batches; ``head``: whether it started in this split.
        now, k, row, state, held, head = None, 0, 0, 0, [], False
        for split, values in by_split(batches):
            if split != now:
                if held:
                    yield piece(row, k, head and state == 0, "\n".join(held))
                now, held, head = split, [], False
                k = where[split]
                # The number of the record that the split starts in, or that of the last one before.
                row, state = int(splits["start"][k]) - 1, int(splits["state"][k])
            odd, full = _looked_at(values)
            starts = (odd[:-1] ^ state == 0) & full
            inside = (odd[:-1] ^ state == 1) | starts
            state ^= int(odd[-1])
            at = np.flatnonzero(starts)
            texts = values.to_pylist()
            lead = int(at[0]) if len(at) else len(texts)
            held += [t for t, i in zip(texts[:lead], inside[:lead], strict=True) if i]
            if len(at) == 0:
                continue
            if held:
                yield piece(row, k, head, "\n".join(held))
            ends = np.append(at[1:], len(texts))
            # Blank lines between records belong to none.
            made = ["\n".join(t for t, i in zip(texts[a:b], inside[a:b], strict=True) if i) if b - a > 1 else texts[a] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            rows = row + 1 + np.arange(len(at))
            row, head, held = int(rows[-1]), True, [made.pop()]
            yield pieces(rows[:-1], k, made)
            if state == 0:
                yield pieces(rows[-1:], k, held)
                held, head = [], False
        if held:
            yield piece(row, k, head and state == 0, "\n".join(held))

    first = {int(r) for r in splits["first"]} if header else set()

    def pieces(rows, k, texts):
        keep = [j for j, r in enumerate(rows.tolist()) if r not in first] if first else range(len(texts))
        texts = [texts[j][:-1] if texts[j].endswith("\r") else texts[j] for j in keep]
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(rows[list(keep)] if n else [], pa.int64()), pa.array([k] * n, pa.int64()), pa.array([True] * n, pa.bool_()), pa.array(texts, pa.string())], names=["row", "split", "whole", "value"])

    def piece(row, k, whole, text):
        if whole:
            return pieces(np.array([row]), k, [text])
        none = row in first
        return pa.RecordBatch.from_arrays([pa.array([] if none else [x], t) for x, t in ((row, pa.int64()), (k, pa.int64()), (False, pa.bool_()), (text, pa.string()))], names=["row", "split", "whole", "value"])

    return run


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(value, _row_id): the text of each record of the CSV files at ``path``, with its line breaks, numbered over all files.

    Cells are quoted by ``"``, which is doubled inside a quoted cell and does not
    occur in others. Lines end in a line feed, before which a carriage return is
    dropped. Blank lines outside of quotes are no records. With ``header`` the first
    record of each file is left out. A quote that is never closed makes one record of
    the rest of its file.
    """
    pieces = lines(spark, path)
    narrow = pieces.select("value", "file", "block")
    found = splits_of(pieces, narrow.mapInArrow(_summaries, _SUMMARY))
    if not len(found):
        return spark.createDataFrame([], f"value string, {ROW} long")
    # A file starts outside of quotes, whatever the file before it left open.
    new = found["path"].ne(found["path"].shift())
    state = found["odd"].groupby(found["path"]).cumsum() - found["odd"]
    found["state"] = state % 2
    found["starts"] = np.where(found["state"] == 0, found["plain"], found["quoted"])
    found["start"] = found["starts"].cumsum() - found["starts"]
    table = {name: found[name].to_numpy() for name in ("file", "block", "state", "start")}
    table["first"] = found["start"].to_numpy()[new.to_numpy()] if header else np.zeros(0, np.int64)
    cut = narrow.mapInArrow(_cut(table, header), _PIECES)
    whole = cut.filter("whole").select("row", "value")
    if (found["state"] == 1).any() or _left_open(found):
        # At most two pieces for each split.
        parts = cut.filter("not whole").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("split", "value"))).alias("parts"))
        joined = parts.select("row", F.rtrim(F.array_join("parts.value", "\n"), F.lit("\r")).alias("value"))
        whole = whole.unionByName(joined)
    # Numbers without the headers before them.
    headers = sorted(int(r) for r in table["first"])
    if headers:
        whole = whole.mapInArrow(_renumbered(np.array(headers, np.int64)), f"{ROW} long, value string")
    else:
        whole = whole.withColumnRenamed("row", ROW)
    return whole.select("value", ROW)


def _left_open(found) -> bool:
    """Whether a file ends inside of quotes."""
    return bool((found["odd"].groupby(found["path"]).sum() % 2 == 1).any())


def _renumbered(headers: np.ndarray):
    def run(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row - np.searchsorted(headers, row, "right")), batch.column(1)], names=[ROW, "value"])

    return run
