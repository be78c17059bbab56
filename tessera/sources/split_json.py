"""JSON documents of any size, read by many tasks: the elements of one list as texts.

A document is scanned in pieces that end at closing braces, so a task sees a stretch
of it. What a stretch means depends on whether it starts inside a string and how
deep it is nested. A first pass gives, for each split and for either state at its
start, the state at its end and the change of depth; sums over the splits give the
state at each start; a second pass finds lists and their elements. An element that a
split's edge runs through is put together from its parts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import ROW, numbered
from .sinks import scratch, write_table
from .split_csv import by_split, lines, splits_of

_SUMMARY = "file long, block long, odd int, plain long, quoted long, first int"
_FOUND = "split long, place long, number long, kind int, value string"
ELEMENT, PART, LIST, OTHER = range(4)
_QUOTE, _BACKSLASH = 34, 92
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def _scanned(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the pieces, each with its closing brace; places of quotes that open or close strings)."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if values.buffers()[2] else np.zeros(0, np.uint8)
    data = np.full(len(raw) + len(values), ord("}"), np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(len(values)), np.diff(offsets))] = raw
    quotes = np.flatnonzero(data == _QUOTE)
    if len(slashes := np.flatnonzero(data == _BACKSLASH)):
        # A quote behind an odd number of backslashes is part of its string.
        first = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, slashes, 0))
        length = np.zeros(len(data) + 1, np.int64)
        length[slashes + 1] = slashes - first + 1
        quotes = quotes[length[quotes] % 2 == 0]
    return data, quotes


def _structure(data: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of brackets and braces outside of strings, their steps), if the bytes start ``inside`` a string or not."""
    at = np.flatnonzero(_STEP[data])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, _STEP[data[at]]


def _summaries(batches):
    now, odd, depth, first = None, 0, [0, 0], 0
    for split, values in by_split(batches):
        if split != now:
            if now:
                yield _summary(now, odd, depth, first)
            now, odd, depth, first = split, 0, [0, 0], 0
        data, quotes = _scanned(values)
        for state in (0, 1):
            at, step = _structure(data, quotes, odd ^ state)
            depth[state] += int(step.sum())
            if state == 0 and not first and len(at):
                first = int(data[at[0]])
        odd = (odd + len(quotes)) % 2
    if now:
        yield _summary(now, odd, depth, first)


def _summary(split, odd, depth, first) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*split, odd, *depth, first), kinds, strict=True)], names=["file", "block", "odd", "plain", "quoted", "first"])


def _key(data: np.ndarray, quotes: np.ndarray, at: int) -> str | None:
    """The key before a bracket."""
    k = int(np.searchsorted(quotes, at))
    if k < 2 or bytes(data[quotes[k - 1] + 1 : at]).strip() != b":":
        return None
    return json.loads(bytes(data[quotes[k - 2] : quotes[k - 1] + 1]))


def _cut(splits: dict[str, np.ndarray]):
    """Lists of a document's top level and the elements of all of them that are lists or objects, by place; an element over several splits comes in parts."""
    where = {key: k for k, key in enumerate(zip(splits["file"].tolist(), splits["block"].tolist(), strict=True))}

    def run(batches):
        # ``held``: an element that isn't closed yet, as (place, number, bytes so far); place and number are -1 if it started in another split.
        now, k, base, inside, depth, level, count, held = None, 0, 0, 0, 0, 0, 0, None
        for split, values in by_split(batches):
            if split != now:
                if held is not None:
                    yield rows(k, [(*held[:2], PART, held[2])])
                now, k = split, where[split]
                base, count, inside, depth, level = 0, 0, int(splits["inside"][k]), int(splits["depth"][k]), int(splits["level"][k])
                held = (-1, -1, b"") if depth > level else None
            data, quotes = _scanned(values)
            at, step = _structure(data, quotes, inside)
            after = depth + np.cumsum(step)
            before = after - step
            opens, closes = at[(step > 0) & (before == level)], at[(step < 0) & (after == level)]
            out = []
            for place in at[(step > 0) & (before == level - 1)].tolist():
                out.append((base + place, -1, LIST if data[place] == ord("[") else OTHER, _key(data, quotes, place) if level == 2 else ""))
            if held is not None:
                held = *held[:2], held[2] + data[: int(closes[0]) + 1 if len(closes) else len(data)].tobytes()
                if len(closes):
                    out.append((*held[:2], PART if held[0] < 0 else ELEMENT, held[2]))
                    held, closes = None, closes[1:]
            # Only objects are counted; lists among the elements are dropped by whoever reads on.
            numbers = count + np.cumsum(data[opens] == ord("{")) - 1
            out += [(base + a, int(n), ELEMENT, data[a : b + 1].tobytes()) for a, b, n in zip(opens.tolist(), closes.tolist(), numbers, strict=False)]
            if len(opens) > len(closes):
                held = base + int(opens[-1]), int(numbers[-1]), data[opens[-1] :].tobytes()
            count = int(numbers[-1]) + 1 if len(opens) else count
            base, inside, depth = base + len(data), (inside + len(quotes)) % 2, int(after[-1]) if len(at) else depth
            if out:
                yield rows(k, out)
        if held is not None:
            yield rows(k, [(*held[:2], PART, held[2])])

    def rows(k, out):
        values = [v if v is None or isinstance(v, str) else v.decode() for *_, v in out]
        cells = ([k] * len(out), [o[0] for o in out], [o[1] for o in out], [o[2] for o in out], values)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["split", "place", "number", "kind", "value"])

    return run


def _within(spans: np.ndarray, document_of: np.ndarray):
    """Rows between the two places, each a split and a place in it, of their document's span."""

    def run(batches):
        for batch in batches:
            split, place = (batch.column(k).to_numpy() for k in range(2))
            from_split, from_place, to_split, to_place = spans[document_of[split]].T
            after = (split > from_split) | ((split == from_split) & (place > from_place))
            before = (split < to_split) | ((split == to_split) & (place < to_place))
            yield batch.filter(pa.array(after & before))

    return run


def _spans(tops, document_of: np.ndarray, data_key: str | None) -> np.ndarray:
    """For each document: the place of its list, and that of the next list or object of its top level; empty where it has no such list."""
    spans = np.zeros((int(document_of[-1]) + 1, 4), np.int64)
    tops = tops.assign(document=document_of[tops["split"].to_numpy(np.int64)])
    for document, group in tops.groupby("document"):
        fits = (group["kind"] == LIST) & ((group["value"] == data_key) if data_key is not None else True)
        if fits.any():
            at = int(fits.to_numpy().argmax())
            places = group[["split", "place"]].to_numpy(np.int64)
            end = places[at + 1] if at + 1 < len(places) else (np.searchsorted(document_of, document, "right"), -1)
            spans[document] = *places[at], *end
    return spans


def json_records(spark: SparkSession, path: str, data_key: str | None = None) -> DataFrame:
    """(value, _row_id): the objects of one list of each JSON document at ``path`` as texts, numbered over all documents.

    A document is a bare list, or an object with a list under ``data_key`` or, without
    a key, with a list anywhere at its top level: the first in the document counts. A
    missing key, and a document without a list, give nothing; elements that are no
    objects are left out. ValueError if a document is neither object nor list, isn't
    closed, or is a bare list where a key is asked for. The key of a list does not
    contain a closing brace.

    What the scan finds is written once to the shared folder. The driver sees a row for
    each split, and one for each list or object at the top level of a document.
    """
    pieces = lines(spark, path, "}")
    narrow = pieces.select("value", "file", "block")
    found = splits_of(pieces, narrow.mapInArrow(_summaries, _SUMMARY))
    if not len(found):
        return spark.createDataFrame([], f"value string, {ROW} long")
    by_path = found.groupby("path", sort=False)
    found["inside"] = (by_path["odd"].cumsum() - found["odd"]) % 2
    found["step"] = np.where(found["inside"] == 0, found["plain"], found["quoted"])
    found["depth"] = by_path["step"].cumsum() - found["step"]
    first = by_path["first"].transform(lambda c: next((x for x in c if x), 0))
    found["level"] = np.where(first == ord("["), 1, 2)
    # The brace that each piece is given ends the last one too, where the text may have none.
    ends = by_path[["step", "odd"]].sum()
    if not first.isin((ord("{"), ord("["))).all() or not ends["step"].isin((0, -1)).all() or (ends["odd"] % 2).any():
        raise ValueError(f"not JSON: {path}")
    if data_key is not None and (found["level"] == 1).any():
        raise ValueError(f"a bare list has no {data_key!r}")
    cut = narrow.mapInArrow(_cut({name: found[name].to_numpy() for name in ("file", "block", "inside", "depth", "level")}), _FOUND)
    cut = write_table(cut, scratch(spark))

    document_of = by_path.ngroup().to_numpy()
    tops = cut.filter(F.col("kind").isin(LIST, OTHER)).select("split", "place", "kind", "value").orderBy("split", "place").toPandas()
    elements = cut.filter(F.col("kind") == ELEMENT).select("split", "place", "number", "value")
    # At most two parts for each split: the start of an element, and what goes on before another one ends.
    parts = cut.filter(F.col("kind") == PART).withColumn("start", F.sum(F.when(F.col("place") >= 0, 1).otherwise(0)).over(W.orderBy("split", "place")))
    whole = parts.groupBy("start").agg(F.min_by(F.struct("split", "place", "number"), "split").alias("at"), F.array_sort(F.collect_list(F.struct("split", "place", "value"))).alias("parts"))
    elements = elements.unionByName(whole.select("at.*", F.array_join("parts.value", "").alias("value"))).filter(F.startswith("value", F.lit("{")))
    inside = elements.mapInArrow(_within(_spans(tops, document_of, data_key), document_of), "split long, place long, number long, value string")
    return numbered(inside.select("value", F.lit("").alias("_file"), F.col("split").alias("_block"), F.col("number").alias("_number")))
