"""Exact top-k by inner product on an impact-ordered index, a score at a time.

Candidates are indexed in blocks. A dimension's posting list is cut into segments
of equal quantised impact. For a query, segments are taken by the most they can
still add, and accumulators hold a proven lower bound of each score. What no
segment has added yet is bounded by the best segment left in each dimension, so
the k-th lower bound proves which candidates can't be among the first k. The rest,
the possible members, are scored exactly.

A query carries the k-th score that it has found in earlier blocks, so that a later
block can be left out as a whole, or after few segments, if it can't reach it. Blocks
are dealt to groups; a first pass asks about the square root of all groups, and the
k-th score found there is the limit with which the others are asked, or not asked at
all where the largest norm of a group proves that it can't be reached.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_batches, materialise

BLOCK, QUERIES, LEVELS = 4096, 256, 4
#: Shares of a block's postings after which the bound is looked at.
STEPS = (0.3, 0.5, 0.7, 0.85, 1.0)
#: Bytes of candidates that a task holds while queries pass by.
HELD = 64 << 20
_LONG = 1 << 63


class Block:
    """An index of vectors of whole numbers (rows of ``x``)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        n, dims = x.shape
        #: The largest component, for the check that sums fit.
        self.most = max(-int(x.min(initial=0)), int(x.max(initial=0)))
        if x.dtype == object:
            return
        shift = max(0, self.most.bit_length() - LEVELS)
        level = x >> shift
        order = np.argsort(level, axis=0, kind="stable").T
        self.postings = np.ascontiguousarray(order).ravel()
        sorted_level = np.take_along_axis(level.T, order, 1)
        head = np.ones((dims, n), bool)
        head[:, 1:] = sorted_level[:, 1:] != sorted_level[:, :-1]
        self.start = np.flatnonzero(head.ravel())
        self.size = np.diff(np.append(self.start, n * dims))
        self.dim = self.start // max(1, n)
        values = np.take_along_axis(x.T, order, 1).ravel()
        self.low, self.high = (f.reduceat(values, self.start) for f in (np.minimum, np.maximum))
        self.first = np.flatnonzero(np.append(True, self.dim[1:] != self.dim[:-1]))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: 64-bit whole numbers where no sum can leave them, else Python's."""
        if self.x.dtype != object and self.most * sum(map(abs, q.tolist())) < _LONG:
            return self.x[rows] @ q
        return self.x[rows].astype(object) @ q.astype(object)

    def search(self, own: int, q: np.ndarray, k: int, least_score: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first k candidates other than those with the id ``own``; ties to the smaller id."""
        rows, scores = self.best_of(self.ids != own, q, k, least_score)
        return self.ids[rows], scores

    def best_of(self, other: np.ndarray, q: np.ndarray, k: int, least_score: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the first k candidates among those marked; ties to the smaller id.

        Candidates that are proven to score below ``least_score`` are left out. The
        accumulators are whole numbers, so the bounds are proofs for components of
        any size; where a sum could leave 64 bits, all candidates are scored.
        """
        n = len(self.ids)
        possible = np.flatnonzero(other)
        if self.x.dtype != object and self.x.shape[1] and len(possible) > k and 4 * self.most * sum(map(abs, q.tolist())) < _LONG:
            w = q[self.dim]
            a, b = w * self.low, w * self.high
            least, most = np.minimum(a, b), np.maximum(a, b)
            if least_score is not None and np.maximum.reduceat(most, self.first).sum() < least_score:
                return possible[:0], np.zeros(0, np.int64)
            floor = np.minimum.reduceat(least, self.first)[self.dim]
            base = int(floor[self.first].sum())
            order = np.argsort(floor - most, kind="stable")
            ends = np.cumsum(self.size[order])
            found, done, pending = np.zeros(n, np.int64), 0, np.ones(len(order), bool)
            for share in STEPS:
                upto = int(np.searchsorted(ends, share * ends[-1])) + 1
                took, done = order[done:upto], max(done, upto)
                for s, gain in zip(took.tolist(), (least - floor)[took].tolist(), strict=True):
                    if gain:
                        # A candidate stands once in a dimension, so no index repeats.
                        found[self.postings[self.start[s] : self.start[s] + self.size[s]]] += gain
                pending[took] = False
                # A dimension adds at most what its best segment left can, or what rounding kept back.
                slack = np.maximum.reduceat(np.where(pending, most - floor, most - least), self.first).sum()
                bound = np.partition(found[other], -k)[-k]
                if least_score is not None:
                    bound = max(bound, least_score - base)
                possible = np.flatnonzero(other & (found + slack >= bound))
                if len(possible) <= max(4 * k, n // 16):
                    break
        score = self.scores(possible, q)
        best = ranked(self.ids[possible], score)[:k]
        return possible[best], score[best]


def ranked(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The order of candidates: by descending score, then by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r])), np.int64)
    return np.lexsort((ids, -scores))


def beyond(score: int) -> str:
    """Empty for a score that fits 64 bits; else digits that sort as such scores do, for sums of up to 700 digits."""
    return "" if -_LONG <= score < _LONG else f"{score if score > 0 else 10**700 + score:0700d}"


def exact(score: int, wide: str | None) -> int:
    """The score that ``beyond`` wrote beside its 64 bits."""
    return score if not wide else int(wide) - (0 if score > 0 else 10**700)


#: Rows of a block are numbered below this; a block's number is that of its task and its place there.
_SPAN = 16


def _blobs(size: int, scale: float):
    """Blocks of up to ``size`` usable vectors: a number, ids and components as bytes, and the largest norm. Shorter vectors are filled with zeros."""

    def packed(ids, vectors):
        dims = max(map(len, vectors), default=0)
        x = np.zeros((len(vectors), dims))
        for row, v in zip(x, vectors, strict=True):
            row[: len(v)] = v
        # Whole numbers beyond 64 bits stay as they are: a double holds them exactly.
        most = np.abs(x).max(initial=0)
        kind = "<i4" if most < 1 << 31 else "<i8" if most < _LONG else "<f8"
        with np.errstate(over="ignore"):
            norm = float(np.sqrt((x * x).sum(1)).max(initial=0))
        return np.array(ids, np.int64).tobytes(), x.astype(kind).tobytes(), dims, kind, norm

    def run(batches):
        ids, vectors, made, number = [], [], [], TaskContext.get().partitionId() << 24
        for batch in batches:
            column = batch.column(1)
            for row, vec_id in enumerate(batch.column(0).to_pylist()):
                if vec_id is None or not column[row].is_valid or column[row].values.null_count:
                    continue
                v = scale * np.asarray(column[row].values, np.float64)
                if np.isfinite(v).all():
                    ids.append(vec_id)
                    vectors.append(np.floor(v))
                if len(ids) == size:
                    made.append(packed(ids, vectors))
                    ids, vectors = [], []
            yield from flush(number, made)
            number, made = number + len(made), []
        yield from flush(number, [packed(ids, vectors)] if ids else [])

    def flush(number, made):
        if made:
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(made)), pa.int64()), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], names=["block", "ids", "x", "dims", "form", "norm"])

    return run


def _unpacked(ids: bytes, x: bytes, dims: int, form: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    x = np.frombuffer(x, form).reshape(len(ids), dims)
    return ids, np.array([[int(c) for c in v] for v in x], object).reshape(x.shape) if form == "<f8" else x.astype(np.int64)


_BLOB = "block long, ids binary, x binary, dims int, form string, norm double"
_FLOORS = "map<long, struct<score: long, wide: string>>"
_FOUND = "query long, query_id long, vec_id long, own boolean, score long, beyond string"


def _reached(norms: np.ndarray):
    """The groups, by their largest norms, that some query of a block could have its first k changed by."""

    def run(batches):
        for batch in batches:
            out = []
            for ids, x, dims, form, floors in zip(*(batch.column(n).to_pylist() for n in ("ids", "x", "dims", "form", "floors")), strict=True):
                q = np.frombuffer(x, form).reshape(len(ids) // 8, dims).astype(np.float64)
                limits = np.full(len(q), -np.inf)
                for row, f in floors or ():
                    limits[row] = float(max(-(10**300), min(10**300, exact(f["score"], f["wide"]))))
                # Rounding is far below the slack; norms beyond doubles reach everything.
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = np.nan_to_num(np.sqrt((q * q).sum(1))[:, None] * norms[None] * (1 + 1e-12) + 1e-6, nan=np.inf)
                out.append(np.flatnonzero((bound >= limits[:, None]).any(0)).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "reach"])

    return run


def _pass(k: int, together: int):
    """The task of a group: its blocks come first and are indexed, then the blocks of queries pass them."""

    def run(batches):
        now, held, seen = None, [], []
        for batch in batches:
            for g, kind, block, ids, x, dims, form, floors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    now, held = g, []
                if kind == 0:
                    held.append(Block(*_unpacked(ids, x, dims, form)))
                    continue
                q_ids, q = _unpacked(ids, x, dims, form)
                limits = {row: exact(f["score"], f["wide"]) for row, f in floors or ()}
                for row, (own, v) in enumerate(zip(q_ids.tolist(), q, strict=True)):
                    found, mine, scores, limit = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), limits.get(row)
                    for index in held:
                        dims = index.x.shape[1]
                        v_fit = v[:dims] if len(v) >= dims else np.append(v, np.zeros(dims - len(v), np.int64))
                        rows, new = index.best_of(np.ones(len(index.ids), bool), v_fit, k, limit)
                        same = (index.ids[rows] == own) & (index.x[rows] == v_fit).all(1) & (not v[dims:].any())
                        found, mine, scores = np.append(found, index.ids[rows]), np.append(mine, same), np.append(scores, new)
                        best = ranked(found, scores)[:k]
                        found, mine, scores = found[best], mine[best], scores[best]
                        if len(best) == k:
                            limit = max(int(scores[-1]), limit) if limit is not None else int(scores[-1])
                    if limits.get(row) is not None:
                        fits = np.array([s >= limits[row] for s in scores.tolist()], bool)
                        found, mine, scores = found[fits], mine[fits], scores[fits]
                    seen.append(((block << _SPAN) + row, own, found, mine, scores))
                if len(seen) >= together:
                    yield flat(seen)
                    seen = []
        if seen:
            yield flat(seen)

    def flat(seen):
        sizes = [len(s[2]) for s in seen]
        column = lambda k: [x for s in seen for x in s[k].tolist()]
        scores = [int(x) for x in column(4)]
        clipped = [min(max(x, -_LONG), _LONG - 1) for x in scores]
        cells = (np.repeat([s[0] for s in seen], sizes), np.repeat([s[1] for s in seen], sizes), column(2), column(3), clipped, list(map(beyond, scores)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["query", "query_id", "vec_id", "own", "score", "beyond"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries``, the k rows of ``df`` with the largest inner product.

    Components become floor(scale * x) and are never cut, and ranks follow the exact
    sums; only a returned score that does not fit 64 bits stands at their end. Every
    row is a candidate but the query's own: one row with its id and vector is left
    out. Ties go to the smaller id. Defined cases: null vectors, null ids and vectors
    with a null or non-finite component, or one that ``scale`` makes so, take no part; a
    shorter vector counts as filled with zeros; a query with fewer candidates returns
    them all; repeated rows are candidates of their own, and repeated queries are
    answered each; empty tables give no rows.

    Candidate blocks are dealt to groups of up to about ``HELD`` bytes, and a task
    indexes those of its group. Each group sends on no more than k + 1 rows for each
    query that is sent to it, and of all but the root of the groups those alone that
    reach the limit found there. The driver sees a number for each group.
    """
    spark = df.sparkSession
    blocks = materialise(map_batches(df.select(id_col, vector_col), _blobs(BLOCK, scale), _BLOB))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = blocks.agg(F.count("*"), F.sum(F.octet_length("x"))).first()
    # A group for each core's worth of blocks, or more if a task could not hold them.
    groups = max(1, min(size[0], max(partitions, (size[1] or 0) // HELD)))
    held = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    norms = np.zeros(groups)
    for r in held.groupBy("g").agg(F.max("norm").alias("norm")).collect():
        norms[r["g"]] = r["norm"]
    asked = materialise(map_batches(queries.select(id_col, vector_col).coalesce(max(1, partitions // 4)), _blobs(QUERIES, scale), _BLOB))
    stride = math.isqrt(groups - 1) + 1
    home = F.pmod(F.col("g"), F.lit(stride)) == F.pmod(F.xxhash64("block"), F.lit(stride))

    def passed(asks: DataFrame, where: Column) -> DataFrame:
        sent = map_batches(asks, _reached(norms), f"{_BLOB}, floors {_FLOORS}, reach array<int>").withColumn("g", F.explode("reach")).filter(where)
        columns = ("g", "kind", "block", "ids", "x", "dims", "form", "floors")
        both = held.withColumns({"kind": F.lit(0), "floors": F.lit(None).cast(_FLOORS)}).select(*columns).unionByName(sent.withColumn("kind", F.lit(1)).select(*columns))
        # Candidates of a group come before its queries.
        both = both.repartitionById(groups, "g").sortWithinPartitions("g", "kind", "block")
        return _best(map_batches(both, _pass(k + 1, QUERIES), _FOUND), k + 1)

    first = materialise(passed(asked.withColumn("floors", F.lit(None).cast(_FLOORS)), home))
    limit = F.struct(F.col("query").bitwiseAND((1 << _SPAN) - 1), F.struct("score", F.col("beyond").alias("wide")))
    floors = first.filter(F.col("rank") == k + 1).groupBy(F.shiftright("query", _SPAN).alias("of")).agg(F.map_from_entries(F.collect_list(limit)).alias("floors"))
    later = passed(asked.join(floors, F.col("block") == F.col("of"), "left").drop("of"), ~home)
    found = first.drop("rank").unionByName(later.drop("rank"))
    # The query's own row is one of those with its id and vector, which rank alike.
    own = F.row_number().over(W.partitionBy("query", "own").orderBy("vec_id"))
    out = _best(found.withColumn("copy", own).filter("not (own and copy = 1)"), k)
    out = materialise(out.select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
    discard(blocks, asked, first)
    return out
