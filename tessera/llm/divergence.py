"""How far the sources of a language lie apart in their terms, by tiles of blocks of sources.

Each source of a language is a vector of counts over the language's terms. Vectors
are packed by chunks of the vocabulary and replicated to the tiles (block of sources
by block of sources) that need them. A tile's task passes over its chunks one after
another and adds up the divergence of each of its pairs, so it never holds more than
one chunk of two blocks, and no pair of sources is ever joined term by term.

All arithmetic is of whole numbers and exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_batches, materialise, raw_bytes, slices

UNIT = 10**9
#: Sources of a block, terms of a chunk (about), and chunks that one task of a tile passes.
BLOCK, CHUNK, STRIPE = 64, 4096, 16
#: A-Z in lower case, and the bytes of terms: letters and whatever is beyond ASCII.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_TERM = np.array([c > 127 or 97 <= c <= 122 for c in range(256)])
_PAIRS = "lang string, source string, item string, n long, item_n long, size long, part long, seen long"


def terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts (bytes and offsets), and the text of each."""
    low = _LOWER[data]
    inside = _TERM[low]
    before, after = np.append(False, inside)[:-1], np.append(inside, False)[1:]
    full = at[:-1] < at[1:]
    before[at[:-1][full]] = after[at[1:][full] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    offsets = np.append(0, np.cumsum(stop - start)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    return found.dictionary_encode(), np.searchsorted(at, start, "right") - 1


def term_counts(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of ``df`` (lang, source, text)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found, doc = terms(*raw_bytes(batch.column(2)))
                size = max(1, len(found.dictionary))
                lang, source = (batch.column(k).dictionary_encode() for k in range(2))
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                code = found.indices.to_numpy().astype(np.int64)
                key, n = np.unique(group[doc] * size + code, return_counts=True)
                once = np.unique(doc * size + code)
                _, docs = np.unique(group[once // size] * size + once % size, return_counts=True)
                pick = lambda array, index: array.take(pa.array(index))
                where = key // size
                columns = [pick(lang.dictionary, where // max(1, len(source.dictionary))), pick(source.dictionary, where % max(1, len(source.dictionary))), pick(found.dictionary, key % size), pa.array(n), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    parts = map_batches(df.select("lang", "source", "text"), run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total) by long division in base 1000, exact for totals below 9 * 10**15."""
    rest = count.astype(np.int64) + 2
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return 1 + out


def _scaled(count: str, total: str) -> str:
    """The same in SQL, exact for any count."""
    return f"1 + CAST({UNIT} AS DECIMAL(20)) * ({count} + 2) div ({total})"


class Tile:
    """The pairs of two blocks of sources, or of one with itself, over the chunks that one task passes."""

    def __init__(self, block: int) -> None:
        self.size = block
        self.groups: list[tuple[int, str, int, int]] = []
        self.row: dict[int, int] = {}
        self.seen = 0
        self.sums: np.ndarray | None = None

    def add(self, place: int, source: str, n: int, size: int) -> None:
        self.row[place] = len(self.groups)
        self.groups.append((place, source, n, size))

    def begin(self) -> None:
        """All sources are known."""
        if self.sums is not None:
            return
        self.total = [n + 2 * size for _, _, n, size in self.groups]
        self.none = np.array([int(scaled(np.zeros(1), t)[0]) if t else 0 for t in self.total], np.int64)
        self.sums = np.zeros((len(self.groups),) * 2, np.int64)
        self.block = np.array([place // self.size for place, *_ in self.groups])

    def chunk(self, vectors: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """(place, numbers of terms, counts) of the sources that have any of a chunk's terms."""
        self.begin()
        known = np.unique(np.concatenate([v[1] for v in vectors]))
        p = np.repeat(self.none[:, None], len(known), axis=1)
        for place, term, count in vectors:
            row = self.row[place]
            p[row, np.searchsorted(known, term)] = scaled(count, self.total[row])
        self.seen += len(known)
        for a in range(len(p)):
            others = self.partners(a)
            if len(others):
                d = p[others] - p[a]
                self.sums[a, others] += (d * d // (p[others] + p[a])).sum(1)

    def partners(self, a: int) -> np.ndarray:
        """Rows after ``a``, of the other block if there are two."""
        after = np.arange(len(self.groups)) > a
        return np.flatnonzero(after & (self.block != self.block[a]) if self.block.min() != self.block.max() else after)

    def rows(self, lang: str):
        """(lang, source, item, their totals, the language's terms, sum over the terms seen, how many those are)."""
        self.begin()
        for a, (_, left, n, size) in enumerate(self.groups):
            for b in self.partners(a).tolist():
                _, right, m, _ = self.groups[b]
                for x in ((left, right, n, m), (right, left, m, n)):
                    yield (lang, *x, size, int(self.sums[a, b]), self.seen)


def _tiles(block: int):
    """Rows of (lang, low, high, stripe, chunk, place, source, n, size, terms), sorted, to sums of pairs; a chunk of -1 announces a source."""

    def run(batches):
        key, tile, chunk, vectors, out = None, None, -1, [], []

        def flush():
            if vectors:
                tile.chunk(vectors)
                vectors.clear()

        def close():
            flush()
            out.extend(tile.rows(key[0]))

        for batch in batches:
            cells = [batch.column(k).to_pylist() for k in range(9)]
            lists = batch.column(9)
            flat, ends = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            term, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for k, (*head, at, place, source, n, size) in enumerate(zip(*cells, strict=True)):
                if head != key:
                    if tile is not None:
                        close()
                    key, tile, chunk = head, Tile(block), -1
                if at == -1:
                    tile.add(place, source, n, size)
                    continue
                if at != chunk:
                    flush()
                    chunk = at
                vectors.append((place, term[ends[k] : ends[k + 1]], count[ends[k] : ends[k + 1]]))
            while len(out) >= 8192:
                yield _batch(out[:8192])
                del out[:8192]
        if tile is not None:
            close()
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 5
    names = ["lang", "source", "item", "n", "item_n", "size", "part", "seen"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from the others of its language, and by which terms.

    A language keeps the terms of at least ``least_docs`` of its documents, V of them.
    A group with count c of a term and N in all gives it p = 1 + floor(UNIT * (c + 2) /
    (N + 2 * V)), and two groups differ at a term by floor((p - q)^2 / (p + q)). Part
    ``pair`` has every other source of the language with the sum over all terms; part
    ``term`` the ``top`` terms that the source has more of than its language, with the
    difference between the two. Ranks go by descending value, ties by item in UTF-8.

    Defined cases: null texts, languages and sources are empty ones, and an empty
    language or source is one like any other; a source without terms has pairs and no
    terms; a language without terms has pairs of value 0; repeated rows are documents
    of their own; further columns are left out; an empty table gives no rows.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = materialise(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n")
    kept = materialise(kept)
    chunks = max(1, -(-kept.count() // CHUNK))
    numbered = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    numbered = numbered.withColumn("number", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")))
    found = materialise(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))

    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size", "lang_total"])
    # A row for each group, whose pairs are returned, so the groups of a language fit a task.
    groups = groups.withColumns({"place": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1, "blocks": F.ceil(F.count("*").over(W.partitionBy("lang")) / BLOCK).cast("int")})
    groups = materialise(groups)

    out = _pairs(found, groups, -(-chunks // STRIPE)).unionByName(_terms(found, groups, top))
    out = materialise(out)
    discard(counts, kept, found, groups)
    return out


def _pairs(found: DataFrame, groups: DataFrame, stripes: int) -> DataFrame:
    packed = found.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("number", "n")).alias("terms"))
    packed = packed.join(groups.select("lang", "source", "place", "blocks"), ["lang", "source"]).withColumn("stripe", F.floor(F.col("chunk") / STRIPE).cast("int"))
    announced = groups.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    announced = announced.select("lang", "source", "place", "blocks", "stripe", F.lit(-1).alias("chunk"), F.col("total").alias("n"), "size")
    both = packed.unionByName(announced, allowMissingColumns=True).withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ("lang", "low", "high", "stripe")
    both = both.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "stripe", "chunk", F.col("place").cast("long"), "source", "n", "size", "terms")
    tiles = map_batches(both.repartition(*key).sortWithinPartitions(*key, "chunk", "place"), _tiles(BLOCK), _PAIRS)
    pairs = tiles.groupBy("lang", "source", "item").agg(F.max("n").alias("n"), F.max("item_n").alias("item_n"), F.max("size").alias("size"), F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    # Terms that no source of the tile has: each of its groups gives them one value.
    pairs = pairs.filter("size > 0").withColumns({"p": F.expr(_scaled("0", "n + 2 * size")), "q": F.expr(_scaled("0", "item_n + 2 * size"))}).withColumn("value", F.expr("part + (size - seen) * ((p - q) * (p - q) div (p + q))")).unionByName(pairs.filter("size = 0").withColumn("value", F.lit(0).cast("long")), allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long"), rank.cast("int").alias("rank"))


def _terms(found: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    x = found.join(groups.select("lang", "source", "total", "size", "lang_total"), ["lang", "source"])
    x = x.withColumns({"p": F.expr(_scaled("n", "total + 2 * size")), "q": F.expr(_scaled("lang_n", "lang_total + 2 * size"))}).filter("p > q")
    x = x.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)
    return x.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long"), F.col("rank").cast("int"))
