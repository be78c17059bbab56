"""Hard negatives by a norm-bucketed search.

Candidates are sorted by norm and cut into buckets, longest vectors first. No score
of a bucket exceeds the anchor's norm times the bucket's largest norm (Cauchy and
Schwarz). An anchor is sent to those groups of buckets alone whose bound reaches its
limit, and within a group it stops at the first bucket that does not. The limit is
the larger of its window's lower end and the k-th score found so far.

Positives come first; their scores set the windows in which negatives are sought.
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
from .topk import beyond, exact, ranked

#: Vectors of a bucket, bytes of the buckets that a task holds at once, anchors that pass them together.
BUCKET, HELD, ANCHORS = 2048, 32 << 20, 256
_EXACT, _LONG = 1 << 53, 1 << 63
_ROW = "id long, label string, x binary, form string, norm double, anchor boolean"
_BUCKETS = "part long, ids binary, labels array<string>, x binary, form string, norm double, anchors binary, rows int"
_ASKS = "uid long, id long, label string, x binary, form string, norm double, scores array<long>, wides array<string>, tags array<long>, floors map<long, struct<score: long, wide: string>>"
_FOUND = "anchor long, anchor_id long, tag long, id long, uid long, score long, wide string"
_NO_LIMIT = -(10**700)


def _rows(scale: float):
    """Usable rows: components as whole numbers, with the norm."""

    def run(batches):
        for batch in batches:
            ids, labels, vectors, anchors = (batch.column(k) for k in range(4))
            out = []
            for k, (row_id, label, anchor) in enumerate(zip(ids.to_pylist(), labels.to_pylist(), anchors.to_pylist(), strict=True)):
                if row_id is None or label is None or not vectors[k].is_valid or vectors[k].values.null_count:
                    continue
                x = np.floor(scale * np.asarray(vectors[k].values, np.float64))
                if np.isfinite(x).all():
                    most = np.abs(x).max(initial=0)
                    # A double holds whole numbers beyond 64 bits exactly.
                    form = "<i4" if most < 1 << 31 else "<f8"
                    with np.errstate(over="ignore"):
                        out.append((row_id, label, x.astype(form).tobytes(), form, float(np.linalg.norm(x)), bool(anchor)))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["id", "label", "x", "form", "norm", "anchor"])

    return run


def _buckets(size: int):
    """Rows in descending order of the norm, to buckets of ``size`` rows of equal length and form."""

    def run(batches):
        part, held, kind = TaskContext.get().partitionId() << 33, [], None

        def packed():
            ids, labels, x, form, norm, anchor = zip(*held, strict=True)
            return part, np.array(ids, np.int64).tobytes(), list(labels), b"".join(x), form[0], max(norm), np.array(anchor).tobytes(), len(held)

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or (row[3], len(row[2])) != kind):
                    done.append(packed())
                    part, held = part + len(held), []
                kind = (row[3], len(row[2]))
                held.append(row)
            yield _bucket_batch(done)
        yield _bucket_batch([packed()] if held else [])

    return run


def _bucket_batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.string(), pa.float64(), pa.binary(), pa.int32())
    names = ["part", "ids", "labels", "x", "form", "norm", "anchors", "rows"]
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=names)


class Bucket:
    """Vectors of up to a norm, as held by a task; ``uids`` number the rows of the table."""

    def __init__(self, part: int, ids: bytes, labels: list[str], x: bytes, form: str, norm: float, rows: int, book: dict[str, int]) -> None:
        self.ids, self.uids, self.norm = np.frombuffer(ids, np.int64), part + np.arange(rows), norm
        self.codes = np.array([book.setdefault(label, len(book)) for label in labels])
        self.x = np.frombuffer(x, form).reshape(rows, -1)
        self.most = float(np.abs(self.x.astype(np.float64)).max(initial=0))

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products with the rows of ``q``, exact: doubles where every sum is below 2**53, else Python's whole numbers."""
        dims = min(q.shape[1], self.x.shape[1])
        q, x = q[:, :dims], self.x[:, :dims]
        if q.dtype != object and self.most * np.abs(q).sum(1).max(initial=0) < _EXACT:
            return q.astype(np.float64) @ x.astype(np.float64).T
        whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
        return whole(q) @ whole(x).T


def _like(limit: int, scores: np.ndarray) -> int | float:
    """A limit in the scores' own kind: where these are doubles, they are whole numbers below 2**53, and rounding keeps the order."""
    return limit if scores.dtype == object else float(max(-(1 << 60), min(1 << 60, limit)))


class Search:
    """One anchor's windows and what they hold so far."""

    def __init__(self, k: int, windows: list[tuple[int, int, int]]) -> None:
        self.k, self.windows = k, windows
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)) for _ in windows]
        self.limits = [low for low, _, _ in windows]

    def add(self, bucket: Bucket, ok: np.ndarray, scores: np.ndarray) -> None:
        for w, (_, high, _) in enumerate(self.windows):
            at = ok[(scores[ok] >= _like(self.limits[w], scores)) & (scores[ok] <= _like(high, scores))]
            if not len(at):
                continue
            ids, uids, have = self.found[w]
            have = np.append(have, [int(s) for s in scores[at]])
            ids, uids = np.append(ids, bucket.ids[at]), np.append(uids, bucket.uids[at])
            best = ranked(ids, have)[: self.k]
            self.found[w] = ids[best], uids[best], have[best]
            if len(best) == self.k:
                self.limits[w] = max(self.limits[w], have[best[-1]])


def search(buckets: list[Bucket], asks: list[tuple], searches: list[Search], same: bool, book: dict[str, int]) -> None:
    """Let anchors (uid, label, vector, norm) pass the buckets of a group, in descending order of their norms."""
    uids, codes = np.array([a[0] for a in asks]), np.array([book.setdefault(a[1], len(book)) for a in asks])
    dims = max(len(a[2]) for a in asks)
    q = np.zeros((len(asks), dims), object if any(a[2].dtype == object for a in asks) else np.int64)
    for row, a in zip(q, asks, strict=True):
        row[: len(a[2])] = a[2]
    norms = np.array([a[3] for a in asks])
    going = np.arange(len(asks))
    for bucket in buckets:
        # Rounding of both norms is far below the slack.
        with np.errstate(invalid="ignore", over="ignore"):
            bound = np.nan_to_num(norms[going] * bucket.norm * (1 + 1e-12) + 1e-6, nan=np.inf)
        going = going[[b >= min(searches[a].limits) for a, b in zip(going.tolist(), bound.tolist(), strict=True)]]
        if not len(going):
            return
        scores = bucket.scores(q[going])
        for row, a in enumerate(going.tolist()):
            fits = bucket.codes == codes[a] if same else bucket.codes != codes[a]
            ok = np.flatnonzero(fits & (scores[row] >= _like(min(searches[a].limits), scores)) & (bucket.uids != uids[a]))
            if len(ok):
                searches[a].add(bucket, ok, scores[row])


def _vector(x: bytes, form: str) -> np.ndarray:
    v = np.frombuffer(x, form)
    return np.array([int(c) for c in v], object) if form == "<f8" else v.astype(np.int64)


def _anchors(k: int, together: int):
    """The anchors of each bucket, each with the k-th score among its own bucket's rows of its label, a first limit, if there are so many."""

    def run(batches):
        for batch in batches:
            for part, ids, labels, x, form, norm, anchors, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                book: dict[str, int] = {}
                bucket = Bucket(part, ids, labels, x, form, norm, rows, book)
                at = np.flatnonzero(np.frombuffer(anchors, bool))
                for cut in np.array_split(at, range(together, len(at), together)):
                    asks = [(part + int(r), labels[r], _vector(bucket.x[r].tobytes(), form), norm) for r in cut]
                    searches = [Search(k, [(_NO_LIMIT, -_NO_LIMIT, 0)]) for _ in asks]
                    if asks:
                        search([bucket], asks, searches, True, book)
                    out = []
                    for r, ask, found in zip(cut.tolist(), asks, searches, strict=True):
                        first = found.limits[0] if len(found.found[0][0]) == k else None
                        own = float(np.linalg.norm(bucket.x[r].astype(np.float64)))
                        out.append((ask[0], int(bucket.ids[r]), ask[1], bucket.x[r].tobytes(), form, own, [_clip(first)] if first is not None else [], [beyond(first)] if first is not None else [], []))
                    yield _ask_batch(out)

    return run


def _clip(score: int) -> int:
    return max(-_LONG, min(_LONG - 1, score))


_FLOOR = pa.map_(pa.int64(), pa.struct([("score", pa.int64()), ("wide", pa.string())]))


def _ask_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()))
    names = ["uid", "id", "label", "x", "form", "norm", "scores", "wides", "tags", "floors"]
    return pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)), pa.nulls(len(out), _FLOOR)], names=names)


def _windows(scores: list[int], wides: list[str], tags: list[int], floors: list[tuple] | None, low: int | None, high: int) -> list[tuple[int, int, int]]:
    """(least score, largest score, tag) of an anchor's windows; without ``low``, one window from its first limit on.

    ``floors``: k-th scores that some groups gave, by tag, below which nothing can be among the first k.
    """
    whole = [exact(s, w) for s, w in zip(scores, wides, strict=True)]
    if low is None:
        made = [(whole[0] if whole else _NO_LIMIT, -_NO_LIMIT, 0)]
    else:
        made = [(-(-low * s // 100), high * s // 100, tag) for s, tag in zip(whole, tags, strict=True)]
    known = {tag: exact(f["score"], f["wide"]) for tag, f in floors or ()}
    made = [(max(least, known.get(tag, least)), most, tag) for least, most, tag in made]
    return [w for w in made if w[0] <= w[1]]


def _reach(groups: np.ndarray, low: int | None, high: int):
    """How many groups, from the first, an anchor's limit lets it reach; ``groups``: their largest norms, descending."""

    def run(batches):
        for batch in batches:
            out = []
            for norm, *lists in zip(*(batch.column(n).to_pylist() for n in ("norm", "scores", "wides", "tags", "floors")), strict=True):
                windows = _windows(*lists, low, high)
                limit = min((w[0] for w in windows), default=None)
                if limit is None:
                    out.append(0)
                elif limit <= 0:
                    out.append(len(groups))
                else:
                    with np.errstate(invalid="ignore", over="ignore"):
                        bound = np.nan_to_num(groups * norm * (1 + 1e-12) + 1e-6, nan=np.inf)
                    out.append(int((bound >= min(limit, 10**300)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "reach"])

    return run


def _pass(k: int, low: int | None, high: int, together: int):
    """The task of a group: its buckets come first, then the anchors that reach it."""

    def run(batches):
        now, buckets, asks, book, out = None, [], [], {}, []

        def flush():
            nonlocal asks
            if asks:
                searches = [Search(k, a[-1]) for a in asks]
                search(buckets, [a[:1] + a[2:5] for a in asks], searches, low is None, book)
                for (uid, anchor_id, *_), s in zip(asks, searches, strict=True):
                    for (_, _, tag), (ids, uids, scores) in zip(s.windows, s.found, strict=True):
                        out.extend((uid, anchor_id, tag, i, u, _clip(c), beyond(c)) for i, u, c in zip(ids.tolist(), uids.tolist(), scores.tolist(), strict=True))
            asks = []

        for batch in batches:
            for g, kind, part, ids, labels, x, form, norm, rows, uid, own, label, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    flush()
                    now, buckets, book = g, [], {}
                if kind == 0:
                    buckets.append(Bucket(part, ids, labels, x, form, norm, rows, book))
                    continue
                asks.append((uid, own, label, _vector(x, form), norm, _windows(*lists, low, high)))
                if len(asks) == together:
                    flush()
            while len(out) >= 8192:
                yield _found_batch(out[:8192])
                del out[:8192]
        flush()
        yield _found_batch(out)

    return run


def _found_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 6, pa.string())
    names = ["anchor", "anchor_id", "tag", "id", "uid", "score", "wide"]
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)


def _searched(buckets: DataFrame, groups: list[float], asks: DataFrame, k: int, low: int | None, high: int) -> DataFrame:
    """The first k of each window of each anchor, in two passes.

    The first pass asks about the square root of all groups, other ones for each
    anchor; the k-th score found there is the limit with which the others are asked.
    A group sends on no more than k rows a window, and in the second pass those alone
    that reach the limit, so the rows sent grow with the root of the groups.
    """
    stride = math.isqrt(max(0, len(groups) - 1)) + 1
    home = F.pmod(F.col("g"), F.lit(stride)) == F.pmod(F.xxhash64("uid"), F.lit(stride))
    first = materialise(_asked(buckets, groups, asks, home, k, low, high))
    floors = first.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("score", "wide")))).alias("floors"))
    later = asks.drop("floors").join(floors, F.col("uid") == F.col("anchor"), "left").drop("anchor").select(*asks.columns)
    return _best(first.drop("rank").unionByName(_asked(buckets, groups, later, ~home, k, low, high).drop("rank")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    first = W.partitionBy("anchor", "tag").orderBy(F.desc("score"), F.desc("wide"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _asked(buckets: DataFrame, groups: list[float], asks: DataFrame, where: Column, k: int, low: int | None, high: int) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema) + ", reach int"
    sent = map_batches(asks, _reach(np.array(groups), low, high), schema).filter("reach > 0").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("reach") - 1))).filter(where)
    sent = sent.select("g", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<string>").alias("labels"), "x", "form", "norm", F.lit(None).cast("int").alias("rows"), "uid", F.col("id").alias("own"), "label", "scores", "wides", "tags", "floors")
    held = buckets.select("g", F.lit(0).alias("kind"), "part", "ids", "labels", "x", "form", "norm", "rows")
    both = held.unionByName(sent, allowMissingColumns=True).repartitionById(max(1, len(groups)), "g")
    both = both.sortWithinPartitions("g", "kind", F.desc("norm"), "part").select(*sent.columns)
    return _best(map_batches(both, _pass(k, low, high, ANCHORS), _FOUND), k)


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``anchor`` holds for: its first ``positives`` other rows of its
    label by inner product, and for each of these the first ``negatives`` rows of
    other labels whose score is between ``low`` and ``high`` hundredths of the
    positive's, ends included. Higher scores come first, ties by smaller id.

    Components become floor(scale * x), and scores are exact at any size; one that
    does not fit 64 bits stands at their end. Defined cases: rows with a null id,
    label or vector, or with a component that is null or not finite (also after
    scaling), take no part; a shorter vector counts as filled with zeros; a repeated
    row is a row of its own, and an anchor leaves out nothing but itself; a negative
    positive score has no window; fewer rows than asked for are all returned; an
    empty table gives no rows; further columns are left out.

    The driver holds a number for each group of buckets, which is up to 32 MB of vectors.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    spark = df.sparkSession
    rows = map_batches(rows, _rows(scale), _ROW)
    # Many norms are equal, so ranges are cut by the id too.
    order = (F.desc("norm"), F.xxhash64("id"))
    packed = map_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order, "id", "label", "x"), _buckets(BUCKET), _BUCKETS)
    packed = materialise(packed)
    # Groups are stretches of buckets in the order of their norms: two for each core, or more if a task could not hold them.
    light = packed.select("part", F.shiftright("part", 33).alias("p"), "norm", F.octet_length("x").cast("long").alias("size"))
    parts = light.groupBy("p").agg(F.sum("size").alias("size")).orderBy("p").toPandas()
    target = max(1, min(HELD, int(parts["size"].sum()) // (2 * spark.sparkContext.defaultParallelism)))
    parts["before"] = parts["size"].cumsum() - parts["size"]
    inside = F.coalesce(F.sum("size").over(W.partitionBy("p").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    light = light.withColumn("inside", inside).join(spark.createDataFrame(parts[["p", "before"]], "p long, before long"), "p")
    groups = materialise(light.groupBy(F.floor((F.col("before") + F.col("inside")) / target).alias("cut")).agg(F.max("norm").alias("norm"), F.min("part").alias("start")))
    listed = groups.orderBy("start").collect()
    place = {r["start"]: g for g, r in enumerate(listed)}
    starts = np.array(sorted(place), np.int64)
    numbers = np.array([place[s] for s in starts.tolist()], np.int32)

    def dealt(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[np.searchsorted(starts, part, "right") - 1], pa.int32())], names=[*batch.schema.names, "g"])

    buckets = map_batches(packed, dealt, f"{_BUCKETS}, g int")
    norms = [r["norm"] for r in listed]
    asks = materialise(map_batches(packed.select("part", "ids", "labels", "x", "form", "norm", "anchors", "rows"), _anchors(positives, ANCHORS), _ASKS))
    liked = materialise(_searched(buckets, norms, asks, positives, None, high).drop("rank", "tag"))
    windows = liked.groupBy("anchor").agg(F.collect_list("score").alias("scores"), F.collect_list("wide").alias("wides"), F.collect_list("uid").alias("tags"))
    asks2 = asks.drop("scores", "wides", "tags").join(windows, F.col("uid") == F.col("anchor")).drop("anchor").select(*asks.columns)
    found = _searched(buckets, norms, asks2, negatives, low, high)
    pairs = liked.select("anchor", F.col("uid").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(pairs, ["anchor", "tag"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = materialise(out)
    discard(packed, groups, asks, liked)
    return out
