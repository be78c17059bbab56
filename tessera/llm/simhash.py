"""SimHash near-duplicates, found by pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of boxes. If two fingerprints differ
in at most ``most`` bits, some box starts a chain whose every prefix of l boxes
holds at most ``l * most / boxes`` differing bits. The first boxes of that chain
have a budget below one, so they are equal: they are the join key. The rest of
the chain prunes a candidate before the full Hamming check.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, discard, free_names, map_batches, materialise, raw_bytes, release

BITS = 64
#: A bucket of more fingerprints than this is linked by neighbour keys, not by pairs.
PAIRS_UP_TO = 32


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: lower-cased A-Z, words between ASCII white space, shingles of ``width`` words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return _simhash(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) for each row: the signed form of the 64-bit fingerprint. A null text has fingerprint zero."""

    def run(batches):
        for batch in batches:
            data, at = raw_bytes(batch.column(1))
            fp = np.array([fingerprint(data[a:b].tobytes(), width) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring(boxes: int) -> list[int]:
    """The bit mask of each box of the ring."""
    cuts = [BITS * k // boxes for k in range(boxes + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def viable(a: Column, b: Column, start: int, boxes: int, most: int) -> Column:
    """Whether the chain from box ``start`` stays within its proportional budget at every length."""
    masks, seen, ok = ring(boxes), 0, F.lit(True)
    for length in range(1, boxes + 1):
        seen |= masks[(start + length - 1) % boxes]
        ok = ok & (F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(seen)))) <= length * most // boxes)
    return ok


def links(fps: DataFrame, most: int = 2, boxes: int = 9) -> DataFrame:
    """(src, dst): edges between distinct fingerprints ``fp``, whose components are those of all pairs at ``most`` or fewer bits.

    Buckets of up to ``PAIRS_UP_TO`` fingerprints are compared pair by pair. In
    larger ones, where pairs would grow with the square, two fingerprints
    within 2 bits meet at a neighbour that differs from both in one bit at most;
    all at one neighbour link to the smallest there. A neighbour has few members,
    so neither way puts a group of unbounded size together, and none drops a link.
    """
    if most > 2:
        raise ValueError("neighbour keys of one flipped bit prove links of 2 bits at most")
    masks = ring(boxes)
    equal = next(n for n in range(boxes, 0, -1) if n * most // boxes == 0)
    chain = [sum(masks[(s + k) % boxes] for k in range(equal)) for s in range(boxes)]
    key = F.array(*[F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(chain[s]))).alias("key")) for s in range(boxes)])
    keyed = fps.select("fp", F.explode(key).alias("k")).select("fp", "k.start", "k.key")
    shared = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = materialise(keyed.join(shared, ["start", "key"]))

    few = keyed.filter(F.col("n") <= PAIRS_UP_TO)
    a, b = few.select("start", "key", F.col("fp").alias("a")), few.select("start", "key", F.col("fp").alias("b"))
    fits = F.lit(False)
    for s in range(boxes):
        fits = fits | ((F.col("start") == s) & viable(F.col("a"), F.col("b"), s, boxes, most))
    pairs = a.join(b, ["start", "key"]).filter(F.col("a") < F.col("b")).filter(fits)
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = keyed.filter(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    around = around.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    middle = around.groupBy("near").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = around.join(middle, "near").filter("fp <> least").select(F.col("fp").alias("src"), F.col("least").alias("dst"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """(id, fp, component) for each row: component is the smallest id that links reach, the row's own included.

    Defined cases: a null or wordless text has fingerprint zero and links like any
    other. Repeated rows and ids each give a row, in the same component. Null ids
    are passed over by the minimum; a component of null ids only is null. An
    empty table gives an empty result. Other columns play no part.
    """
    rows = materialise(fingerprints(df, id_col, text_col, width))
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = materialise(components(links(classes.select("fp"), most)))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(rooted.join(named, "root").select("fp", "component"))
    return rows.join(named, "fp").select("id", "fp", "component")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays.

    Rows that share an id are one document and stay or go together; rows without
    an id always stay.
    """
    (name,) = free_names(df, "gone")
    gone = near_duplicates(df, id_col, text_col, width, most).filter(F.col("id") > F.col("component")).select(F.col("id").alias(name)).distinct()
    return df.join(materialise(gone), F.expr(f"`{id_col}` = `{name}`"), "left_anti")


# --- texts that share most of their shingles ---

#: Words of 64 bits in a parity.
WORDS = 16
#: And of the longer one that candidates are compared by before their shingles are.
LONGER = 128
#: Bits of the set that tells which texts to read again; it has the same size whatever the input's.
MARKS = 1 << 24
#: Texts of the sample that shows which shingles are common, how many of them make one common, and the most that are named.
SAMPLE, COMMON, NAMED = 20000, 3, 1 << 17
#: A bucket is compared in blocks of about this many classes.
BLOCK = 2048


def shingle_hashes(text: bytes, width: int = 5) -> np.ndarray:
    """The hashes of the distinct shingles of a text in ascending order; none if there is no word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), 42) for s in shingles), np.uint64, len(shingles)))


def _node(h: np.ndarray) -> int:
    """A number for a set of shingles."""
    return xxh64_intdigest(h.tobytes(), 42)


def _simhash(h: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes."""
    ones = sum((np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for part in np.array_split(h, 1 + len(h) // 65536)), np.zeros(BITS, np.int64))
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def parity(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64 bits for each of ``words`` numbers, a power of 2: which parts of the range of hashes hold an odd number of them.

    A hash that only one of two sets has flips one bit, so the bits that differ
    between two sets are never more than the hashes that do.
    """
    odd = np.bincount((h >> np.uint64(65 - (BITS * words).bit_length())).astype(np.int64), minlength=BITS * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def prefix(h: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of n hashes, in the order that all texts share: uncommon ones first, then by weight; ties by value.

    A set that shares 0.8 with another one holds at least 4 n / 5 of its hashes, and
    so does the other one for its own number: the first hash that both have is in both prefixes.
    """
    if not len(h):
        return h
    return h[np.lexsort((h, _weights(h, common, weight)))][: len(h) // 5 + 1]


def _weights(h: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """In how many texts of the sample each hash is; 0 if it is not common."""
    if not len(common):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return np.where(common[at] == h, weight[at], 0)


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that a sample shows to be common, ascending, and in how many of its texts each is. This steers cost only."""

    def run(batches):
        for batch in batches:
            data, at = raw_bytes(batch.column(0))
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(data[a:b].tobytes(), width).view(np.int64))], names=["h"])

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, texts.count() // SAMPLE))) == 0).select("text")
    counts = map_batches(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "h").limit(NAMED).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


_F = [f"f{k}" for k in range(WORDS)]


def _may_share(a: str, b: str) -> Column:
    """Whether sets ``a`` and ``b`` (prefixes of the columns size, f0 to f15) can share 0.8: false is proven.

    They do if at most a ninth of both sizes together is in one of them only.
    """
    differ = sum((F.bit_count(F.col(a + f).bitwiseXOR(F.col(b + f))) for f in _F[1:]), F.bit_count(F.col(a + _F[0]).bitwiseXOR(F.col(b + _F[0]))))
    x, y = F.col(f"{a}size"), F.col(f"{b}size")
    return (5 * x >= 4 * y) & (5 * y >= 4 * x) & (9 * differ <= x + y)


def _named(ahead: str, *cols: str) -> list[Column]:
    return [F.col(c).alias(ahead + c) for c in cols]


def ringed(classes: DataFrame, most: int = 2) -> DataFrame:
    """(src, dst): classes whose SimHash fingerprints ``links`` joins by pigeonring, and classes of one fingerprint, each with its smallest."""
    same = materialise(classes.groupBy("fp").agg(F.min("node").alias("first")))
    within = classes.join(same, "fp").filter("node > first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    of = lambda end: same.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node"))
    across = links(same.select("fp"), most).join(of("src"), "src").join(of("dst"), "dst")
    return within.unionByName(across.select(F.greatest("src_node", "dst_node").alias("src"), F.least("src_node", "dst_node").alias("dst")))


def keyed(classes: DataFrame) -> DataFrame:
    """(key, node, n, least, hub): a row for each class and hash of its prefix that other classes have in theirs.

    n: how many they are; least: the smallest of them; hub: that with the fewest
    hashes of its own, as the text that others are copies of has. Hashes that the
    same classes have, as those of a passage have, are one key: two 64-bit sums over
    the classes tell.
    """
    each = classes.select("node", "own", F.explode("prefix").alias("key"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(seed))) for seed in (1, 2)]
    shared = each.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.min(F.struct("own", "node")).alias("hub"), *(x.alias(f"s{k}") for k, x in enumerate(same))).filter("n > 1")
    one = shared.groupBy("n", "least", "s0", "s1").agg(F.min("key").alias("key"), F.min("hub").alias("hub"))
    return each.drop("own").join(one.select("key", "n", "least", F.col("hub.node").alias("hub")), "key")


def stars(keys: DataFrame) -> DataFrame:
    """(src, dst): each class of a bucket with its smallest one and its hub."""
    to = lambda end: keys.filter(F.col("node") != F.col(end)).select(F.greatest("node", end).alias("src"), F.least("node", end).alias("dst"))
    return to("least").unionByName(to("hub"))


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct (src, dst) of ``pairs`` that can share 0.8."""
    found = pairs.distinct()
    for end in ("src", "dst"):
        found = found.join(classes.select(F.col("node").alias(end), *_named(f"{end}_", "size", *_F)), end)
    return found.filter(_may_share("src_", "dst_")).select("src", "dst")


def crossings(keys: DataFrame, classes: DataFrame, rooted: DataFrame) -> DataFrame:
    """(src, dst, a, b): all pairs of a bucket that can share 0.8 and are under different roots a and b in ``rooted`` (node, root).

    Buckets under one root are done. The others are compared in blocks: a class
    is in one block of its bucket and is sent to the blocks from there on. Only
    pairs that can share 0.8 come out of the join.
    """
    open_ = materialise(keys.filter("n > 2").select("key", "node").join(rooted.select("node", "root"), "node"))
    mixed = open_.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    left = open_.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").join(classes.select("node", "size", *_F), "node")
    left = materialise(left)
    discard(open_)
    cols = ("node", "root", "size", *_F)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    a = left.select("key", own.alias("block"), *_named("a_", *cols))
    b = left.select(F.col("key").alias("b_key"), own.alias("home"), F.explode(F.sequence(own, F.col("blocks") - 1)).alias("sent"), *_named("b_", *cols))
    both = ((F.col("home") != F.col("block")) | (F.col("a_node") > F.col("b_node"))) & (F.col("a_root") != F.col("b_root")) & _may_share("a_", "b_")
    on = (F.col("key") == F.col("b_key")) & (F.col("block") == F.col("sent")) & both
    ends = lambda f, of: f(F.col(f"a_{of}"), F.col(f"b_{of}"))
    found = a.join(b, on).select(ends(F.greatest, "node").alias("src"), ends(F.least, "node").alias("dst"), ends(F.greatest, "root").alias("a"), ends(F.least, "root").alias("b"))
    found = materialise(found.distinct())
    discard(left)
    return found


def _mark(of: str, mark: str) -> Column:
    """The bit of a text: by its id, or by its content if it has none."""
    return F.pmod(F.xxhash64(of, F.when(F.col(of).isNull(), F.col(mark))), F.lit(MARKS))


def _alike(texts: DataFrame, maybe: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Of ``maybe`` (src, dst): the pairs whose texts share 0.8 or more of their shingles. ``texts``: (id, text, mark).

    A class stands for its text with the smallest id, or if none has an id with
    the smallest mark. Only these and the few that share a bit with one of them
    are read for their shingles, and no text is shuffled.
    """
    nodes = maybe.select(F.col("src").alias("node")).unionByName(maybe.select(F.col("dst").alias("node"))).distinct()
    wanted = materialise(classes.join(nodes, "node").select("node", _mark("least", "mark").alias("bit")))
    parts = wanted.groupBy(F.expr("bit div 32768").alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()
    marked = np.zeros((MARKS // 32768, 4096), np.uint8)
    for r in parts:
        marked[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    marked = marked.ravel()

    def run(batches):
        for batch in batches:
            bit = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((marked[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            data, at = raw_bytes(batch.column(1))
            sets = [shingle_hashes(data[a:b].tobytes(), width) for a, b in zip(at[:-1], at[1:], strict=True)]
            same = np.array([_node(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(same), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([parity(h, LONGER).view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "hashes", "bits"])

    sets = map_batches(texts.select(_mark("id", "mark").alias("bit"), "text"), run, "node long, hashes array<long>, bits array<long>")
    sets = materialise(sets.groupBy("node").agg(F.min("hashes").alias("hashes"), F.min("bits").alias("bits")))
    release(texts.sparkSession)
    # Most candidates are proven to share less by bits that are far shorter than their shingles.
    bits = lambda end: sets.select(F.col("node").alias(end), F.size("hashes").alias(f"{end}_n"), F.col("bits").alias(f"{end}_b"))
    differ = F.aggregate(F.zip_with("src_b", "dst_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    maybe = materialise(maybe.join(bits("src"), "src").join(bits("dst"), "dst").filter(9 * differ <= F.col("src_n") + F.col("dst_n")).select(*maybe.columns))
    release(texts.sparkSession)
    side = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_h"))
    both = maybe.join(side("src"), "src").join(side("dst"), "dst")
    shared, total = F.size(F.array_intersect("src_h", "dst_h")), F.size("src_h") + F.size("dst_h")
    alike = materialise(both.filter(9 * shared >= 4 * total).select(*maybe.columns))
    discard(sets, wanted)
    return alike


def _rooted(nodes: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """``nodes`` with root: the smallest node that ``edges`` (src, dst) reach from ``column``, itself included."""
    roots = materialise(components(edges)).select(F.col("node").alias("__of"), "root")
    return nodes.join(roots, F.col(column) == F.col("__of"), "left").select(*nodes.columns, F.coalesce("root", column).alias("root"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, component) for each row: groups of texts with 0.8 or more of their shingles in common, linked through others too.

    Texts whose SimHash fingerprints lie within 2 bits are found by pigeonring and
    compared by their shingles. Fingerprints prove nothing about texts further
    apart, so those are found exactly: texts that share 0.8 share a hash of their
    prefixes, and every pair that does is compared by its shingles, is proven to
    share less, or is linked through others already. Texts that differ only in case
    or white space, or have the same shingles, are always together. Defined cases
    are those of ``near_duplicates``; wordless texts are one group.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("mark", F.when(F.col("id").isNull(), F.xxhash64("text")))
    common, weight = _common(texts, width)

    def run(batches):
        for batch in batches:
            data, at = raw_bytes(batch.column(1))
            sets = [shingle_hashes(data[a:b].tobytes(), width) for a, b in zip(at[:-1], at[1:], strict=True)]
            node, fp = (pa.array(np.array([f(h) for h in sets], np.uint64).view(np.int64)) for f in (_node, _simhash))
            first = pa.array([prefix(h, common, weight).view(np.int64) for h in sets], pa.list_(pa.int64()))
            size, own = (pa.array([f(h) for h in sets], pa.int64()) for f in (len, lambda h: np.count_nonzero(_weights(h, common, weight) == 0)))
            bits = np.array([parity(h) for h in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, fp, size, own, first, *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], names=["id", "mark", "node", "fp", "size", "own", "prefix", *_F])

    rows = materialise(map_batches(texts, run, f"id {kind}, mark long, node long, fp long, size long, own long, prefix array<long>, " + ", ".join(f"{c} long" for c in _F)))
    classes = materialise(rows.groupBy("node").agg(*[F.min(c).alias(a) for c, a in (("id", "least"), *((c, c) for c in ("mark", "fp", "size", "own", "prefix", *_F)))]))
    ids = materialise(rows.select("id", "node"))
    discard(rows)
    release(df.sparkSession)
    keys = materialise(keyed(classes))
    release(df.sparkSession)
    pairs = materialise(promising(ringed(classes).unionByName(stars(keys)), classes))
    release(df.sparkSession)
    found = _alike(texts, pairs, classes, width)
    rooted = materialise(_rooted(classes.select("node", "least"), "node", found))
    release(df.sparkSession)
    pairs = crossings(keys, classes, rooted)
    discard(keys)
    release(df.sparkSession)
    more = _alike(texts, pairs, classes, width).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    rooted = _rooted(rooted.withColumnRenamed("root", "was"), "was", more).select("node", "least", "root")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(rooted.join(named, "root").select("node", "component"))
    discard(classes)
    return ids.join(named, "node").select("id", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``df`` without all but the smallest id of each group of ``similar``; rows without an id always stay."""
    (name,) = free_names(df, "gone")
    gone = similar(df, id_col, text_col, width).filter(F.col("id") > F.col("component")).select(F.col("id").alias(name)).distinct()
    return df.join(materialise(gone), F.expr(f"`{id_col}` = `{name}`"), "left_anti")
