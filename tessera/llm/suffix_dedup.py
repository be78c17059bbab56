"""Exact removal of repeated passages by prefix-free parsing.

A rolling hash over ``GRAM`` bytes sets the triggers: the smallest hash within a
window of ``length`` bytes. Windows with the same trigger form a phrase, and
phrases overlap by ``length - 1`` bytes, so that every window of the corpus lies
whole in one phrase and the order of suffixes to that depth is settled inside the
dictionary of distinct phrases. The parse (the place of every phrase) gives the
corpus order: all but the earliest place of a phrase are repeats. Only phrases
that share a trigger with another phrase can hold a window that occurs elsewhere;
of those the suffix array of the dictionary is built, to the depth of ``length``
bytes, and each class of equal suffixes keeps its earliest corpus place.

The corpus is met in parts. Each task parses its share, keeps the first place of
each phrase or suffix class there, and sends packed arrays by hash bucket; a
repeat found inside a part is settled there, so that a passage in a third of all
documents leaves at most one entry for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import free_names, map_batches, materialise, raw_bytes, release, slices

#: Fixed parameters of the parse. They steer cost only: any values give the same result.
GRAM, CHUNK, FLUSH, BASE, SEED = 45, 1 << 17, 1 << 18, 0x9E3779B97F4A7C15, 20240229
#: Bits of ``a``, uniform over their range. Sorted, they leave as differences, which are short.
KEY_BITS = 48
_PLACE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
_FLAT = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
REPEAT, SHARED, HOT = 0, 1, 2
#: Distinct phrases under one trigger that a part sends to one bucket; the others are dealt by content.
CROWD = 256
#: Most bytes of text for each bucket, which one Python worker holds: at some 130 bytes for a place and one every 27 bytes of text, about 320 MB.
BUCKET = 1 << 26


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Parser:
    """Cuts texts, laid one after another, into phrases."""

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, min(GRAM, length)
        self.width = length - self.gram + 1
        self.up, self.down = _powers(CHUNK + 2 * length + 1)
        self.codes = np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64)

    def _triggers(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window start in ``data``: the place of its trigger; for each place: the rolling hash."""
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=total[1:])
        h = (total[self.gram :] - total[: -self.gram]) * self.down[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < self.width:
            step = min(done, self.width - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        return (low & np.uint64(0xFFFFFF)).astype(np.int64), h

    def phrases(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Arrays of places; a: hash of the trigger, b: of the phrase's bytes. ``at``: where texts start and end."""
        for low in range(0, max(0, len(data) - self.length + 1), CHUNK):
            part = data[low : low + CHUNK + self.length - 1]
            trigger, h = self._triggers(part)
            first = np.arange(len(trigger), dtype=np.int64)
            row = np.searchsorted(at, low + first, "right") - 1
            whole = low + first + self.length <= at[row + 1]
            new = np.ones(len(first), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
            heads = np.flatnonzero(new & whole)
            if not len(heads):
                continue
            marks = np.append(np.flatnonzero(new | ~whole), len(first))
            n = marks[np.searchsorted(marks, heads, "right")] - heads
            out = np.empty(len(heads), _PLACE)
            view = memoryview(np.ascontiguousarray(part))
            out["a"] = (h[trigger[heads]] * np.uint64(BASE)) >> np.uint64(64 - KEY_BITS)
            out["b"] = np.fromiter((xxh3_64_intdigest(view[s:e]) for s, e in zip(heads.tolist(), (heads + n + self.length - 1).tolist(), strict=True)), np.uint64, len(heads))
            out["doc"], out["start"], out["n"] = ids[row[heads]], low + heads - at[row[heads]], n
            yield out


def _firsts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest place of each (a, b), in order of a; the other places). A place that comes twice is one."""
    x = places[np.lexsort((places["start"], places["doc"], places["b"], places["a"]))]
    head = np.ones(len(x), bool)
    head[1:] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
    of = np.maximum.accumulate(np.where(head, np.arange(len(x)), 0))
    other = (x["doc"] != x["doc"][of]) | (x["start"] != x["start"][of])
    return x[head], x[other]


def _packed(places: np.ndarray, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """The first places by bucket of a; the repeats, joined to runs, by bucket of their document."""
    first, rest = _firsts(places)
    rest = _runs(rest, length)
    # Phrases beyond CROWD under one trigger share it for certain: the others tell its bucket so.
    lead = np.flatnonzero(np.append(True, first["a"][1:] != first["a"][:-1])) if len(first) else np.zeros(0, np.int64)
    spot = np.arange(len(first)) - np.repeat(lead, np.diff(np.append(lead, len(first))))
    kinds = ((SHARED, first[spot < CROWD], "a"), (HOT, first[spot >= CROWD], "b"), (REPEAT, rest, "doc"))
    for kind, x, by in kinds:
        if len(x):
            key = np.ascontiguousarray(x[by]).view(np.uint64)
            if kind == SHARED:
                # Ranges of a, so that a bucket's keys are in order and near each other.
                key = ((key >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
            else:
                key = ((key * np.uint64(BASE)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(key, kind="stable")
                x, key = x[order], key[order]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            blobs = [_blob(kind, part) for part in np.split(x, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(key[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int8)), pa.array(blobs, pa.binary())], schema=_BLOB)


def _runs(x: np.ndarray, length: int) -> np.ndarray:
    """Repeated windows that follow each other in a document, joined."""
    if not len(x):
        return x
    x = x[np.lexsort((x["start"], x["doc"]))]
    ends = x["start"] + x["n"]
    head = np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["start"][1:] > ends[:-1]))
    out = x[head]
    out["n"] = np.maximum.reduceat(ends, np.flatnonzero(head)) - out["start"]
    return out


def _columns(kind: int) -> tuple[str, ...]:
    return ("doc", "start", "n") if kind == REPEAT else _PLACE.names


def _blob(kind: int, x: np.ndarray) -> bytes:
    """The columns as byte planes (all lowest bytes first), which the shuffle's codec compresses well; ``a`` as differences."""
    out = []
    for c in _columns(kind):
        column = np.diff(x[c], prepend=np.uint64(0)) if c == "a" and kind == SHARED else np.ascontiguousarray(x[c])
        out.append(column.view(np.uint8).reshape(len(x), -1).T.tobytes())
    return b"".join(out)


def _unpacked(kind: int, blob: bytes) -> np.ndarray:
    names = _columns(kind)
    n = len(blob) // sum(_PLACE[c].itemsize for c in names)
    out, at = np.zeros(n, _PLACE), 0
    for c in names:
        size = n * _PLACE[c].itemsize
        planes = np.frombuffer(blob, np.uint8, size, at).reshape(-1, n)
        out[c] = np.ascontiguousarray(planes.T).view(_PLACE[c]).ravel()
        at += size
    if kind == SHARED:
        out["a"] = np.cumsum(out["a"], dtype=np.uint64)
    return out


def _collected(parts: Iterator[np.ndarray], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= FLUSH:
            yield from _packed(np.concatenate(held), buckets, length)
            held, n = [], 0
    if held:
        yield from _packed(np.concatenate(held), buckets, length)


def _resolve(length: int, shared: bool):
    """Of rows sorted by bucket: the repeats and, if wanted, the phrases that share their trigger with another."""

    def flat(kind: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), *(pa.array(np.ascontiguousarray(x[c])) for c in ("doc", "start", "n"))], schema=_FLAT)

    def settle(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            first, rest = _firsts(np.concatenate(parts))
            if len(rest):
                yield flat(REPEAT, _runs(rest, length))
            if shared and len(first):
                same = np.append(False, first["a"][1:] == first["a"][:-1]) | (kind == HOT)
                same[:-1] |= same[1:]
                if same.any():
                    yield flat(SHARED, first[same])

    def run(batches):
        held, now = {}, None
        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == REPEAT:
                    yield flat(REPEAT, _unpacked(kind, blob))
                    continue
                if bucket != now:
                    yield from settle(held)
                    held, now = {}, bucket
                held.setdefault(kind, []).append(_unpacked(kind, blob))
        yield from settle(held)

    return run


def _suffixes(length: int):
    """The suffix array of each part of the dictionary, to the depth of ``length`` bytes; a, b: digest of the class of equal suffixes."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            data, at = raw_bytes(batch.column(1))
            spans, counts = batch.column(2).flatten(), np.diff(np.asarray(batch.column(2).offsets))
            start, n = (np.asarray(spans.field(c)).astype(np.int64) for c in (0, 1))
            row = np.repeat(np.repeat(np.arange(batch.num_rows), counts), n)
            start = np.repeat(start - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            doc, text = np.asarray(batch.column(0))[row], memoryview(np.ascontiguousarray(data))
            windows, place = np.lib.stride_tricks.sliding_window_view(data, length), at[row] + start
            for low in range(0, len(place), 1 << 16):
                part = slice(low, low + (1 << 16))
                suffixes = windows[place[part]].view(f"S{length}").ravel()
                order = np.argsort(suffixes, kind="stable")
                head = np.append(True, suffixes[order][1:] != suffixes[order][:-1])
                digests = np.frombuffer(b"".join([xxh3_128_digest(text[p : p + length]) for p in place[part][order[head]].tolist()]), "<u8").reshape(-1, 2)
                out = np.empty(len(order), _PLACE)
                of = digests[np.cumsum(head) - 1]
                out["a"][order], out["b"][order] = of[:, 0] >> np.uint64(64 - KEY_BITS), of[:, 1]
                out["doc"], out["start"], out["n"] = doc[part], start[part], 1
                yield out

    return run


def _numbered(keys: DataFrame) -> DataFrame:
    """``keys`` (i, g) with doc: their places in order, null last. Ranges are sorted one by one and counted, and a range starts where those before it end."""
    order = [F.col("i").asc_nulls_last(), F.col("g")]
    keys = materialise(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = keys.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return keys.withColumn("place", place).join(counts.select("part", before.alias("start")), "part").select("i", "g", (F.col("start") + F.col("place")).alias("doc"))


def _documents(df: DataFrame, id_col: str, text_col: str, doc: str) -> DataFrame:
    """``df`` with ``doc``: the number of each document in order; rows with equal id and text are one document."""
    seen = df.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(F.col(id_col).isNull())).first()
    if df.schema[id_col].dataType.simpleString() in ("bigint", "int") and (seen[0] or 0) <= 1 and not seen[1]:
        return df.withColumn(doc, F.col(id_col).cast("long"))
    digest, i, g = free_names(df.withColumn(doc, F.lit(0)), "digest", "i", "g")
    df = df.withColumn(digest, F.xxhash64(text_col))
    keys = materialise(_numbered(df.select(F.col(id_col).alias("i"), F.col(digest).alias("g")).distinct()))
    keys = keys.withColumnsRenamed({"i": i, "g": g, "doc": doc})
    return df.join(keys, F.expr(f"`{id_col}` <=> `{i}` and `{digest}` = `{g}`")).drop(i, g, digest)


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, start, n): n windows from ``start`` on occur earlier too. ``docs``: (doc, text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * parts, size // BUCKET)
    blob, flat = "bucket int, kind byte, blob binary", "kind byte, doc long, start int, n int"

    def parse(batches):
        parser = Parser(length)

        def places():
            for batch in batches:
                yield from parser.phrases(*raw_bytes(batch.column(1)), np.asarray(batch.column(0)))

        yield from _collected(places(), buckets, length)

    def suffixes(batches):
        yield from _collected(_suffixes(length)(batches), buckets, length)

    def deal(rows: DataFrame, shared: bool) -> DataFrame:
        made = materialise(map_batches(rows.repartition(parts, "bucket").sortWithinPartitions("bucket"), _resolve(length, shared), flat))
        del rows
        release(spark)
        return made

    found = deal(map_batches(docs, parse, blob), True)
    lists = found.filter(f"kind = {SHARED}").groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    more = deal(map_batches(docs.join(lists, "doc").select("doc", "text", "spans"), suffixes, blob), False)
    return found.filter(f"kind = {REPEAT}").unionByName(more).select("doc", "start", "n")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``df`` without its text, with kept (binary), n_bytes, n_removed and n_spans: each text without strings that start earlier too.

    A byte goes if a string of ``length`` bytes covers it that also starts
    earlier: in a document with a smaller id, or before in its own. Strings are
    judged on the input, overlaps count, and no string crosses documents.

    Defined cases: a null text is empty; texts shorter than ``length`` stay whole;
    null ids come last; rows with equal id and text are one document and get the
    same result, rows with equal ids and different texts are two, ordered by a
    hash of the text. Bytes, not characters, are removed. Columns of these names
    in ``df`` are replaced, others stay.
    """
    made = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    rest = [f for f in df.schema if f.name != text_col and f.name not in made]
    doc, of, spans = free_names(df, "doc", "of", "spans")
    df = df.select(*(f"`{f.name}`" for f in rest), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col))
    docs = _documents(df, id_col, text_col, doc)
    lists = repeats(docs.select(F.col(doc).alias("doc"), F.col(text_col).alias("text")), length)
    lists = lists.groupBy(F.col("doc").alias(of)).agg(F.collect_list(F.struct("start", "n")).alias(spans))

    def run(batches):
        for batch in batches:
            data, at = raw_bytes(batch.column(0))
            lists = batch.column(1)
            kept, figures = [], np.zeros((batch.num_rows, 3), np.int64)
            for row in range(batch.num_rows):
                text = data[at[row] : at[row + 1]]
                figures[row, 0] = len(text)
                if lists[row].is_valid:
                    spans = lists[row].values
                    start, n = (np.asarray(spans.field(c)).astype(np.int64) for c in (0, 1))
                    edge = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + n + length - 1, minlength=len(text) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    figures[row, 1:] = gone.sum(), gone[0] + np.count_nonzero(gone[1:] & ~gone[:-1])
                    text = text[~gone]
                kept.append(text.tobytes())
            columns = [*batch.columns[2:], pa.array(kept, pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in figures.T)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), *made])

    joined = docs.join(lists, F.col(doc) == F.col(of), "left").select(F.col(f"`{text_col}`"), spans, *(f"`{f.name}`" for f in rest))
    return map_batches(joined, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{c} {t}" for c, t in made.items()]))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``df`` with its texts cut by ``remove_repeats``; what is left of a character cut in part goes too. Null texts become empty."""
    made = ("kept", "n_bytes", "n_removed", "n_spans")
    clash = {c: c2 for c, c2 in zip(made, free_names(df, *[f"own_{c}" for c in made]), strict=True) if c in df.columns}
    cut = remove_repeats(df.withColumnsRenamed(clash), id_col, text_col, length)
    valid = F.is_valid_utf8(F.col("kept").cast("string"))
    # Bytes that form no character become U+FFFD and are taken out; texts that hold U+FFFD themselves and are valid stay as they are.
    text = F.when(valid, F.col("kept").cast("string")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    return cut.withColumn(text_col, text).drop(*made).withColumnsRenamed({v: k for k, v in clash.items()}).select(*df.columns)
