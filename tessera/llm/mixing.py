"""Mixing sources to target weights.

Words are summed for each source, targets follow from the weights, and a source's
rate is its target over its size. A document is emitted floor(rate) times, and once
more by a hash-seeded draw whose probability is the fraction.

The draws of a source depend on each other, so that even a source of a few
documents of uneven length meets its target: ids are hashed to bins, the bins of
each class of sizes are taken in order up to its share, and what a class of long
documents takes too much or too little is made up for in the next shorter class.
A document's outcome is a comparison with its class's limit, so texts are never
shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, materialise

#: Bins of ids. A class is taken to the bin, so a 4096th of it or a single document is its finest step.
BINS = 4096


def n_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, source_col: str = "source", cycle: int = 3) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh 1 to ``cycle``, repeating. One row for each source is ordered, never documents."""
    place = F.row_number().over(W.orderBy(F.col(source_col).cast("binary").asc_nulls_last()))
    return sources.select(source_col).distinct().select(source_col, ((place - 1) % cycle + 1).cast("double").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, source_col: str = "source", most: float = 3.0, total: float | None = None) -> DataFrame:
    """(source, source_size, target, copies, fraction): the share of ``total`` (all sizes, unless given) by weight.

    A target stops at ``most`` times its source's size, and the excess is shared
    anew by weight until none is above. Each round brings two sums to the driver.
    Sources without a weight, or of weight 0, get nothing.
    """
    x = sizes.alias("s").join(weights.alias("w"), F.expr(f"s.`{source_col}` <=> w.`{source_col}`"), "left")
    x = materialise(x.select(F.col(f"s.{source_col}"), F.col("s.source_size"), F.coalesce("weight", F.lit(0.0)).alias("weight")))
    cap = most * F.col("source_size")
    if total is None:
        total = float(x.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * level >= cap
        held, free, n = x.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if not free or n == stopped:
            break
        level, stopped = max(level, (total - held) / free), n
    target = F.least(F.col("weight") * level, cap)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    x = x.select(source_col, "source_size", target.alias("target"), F.least(rate, F.lit(most)).alias("rate"))
    return x.select(source_col, "source_size", "target", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("fraction"))


def bin_of(seed: int, key: Column) -> Column:
    """The bin of an id, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BINS)).cast("int")


def size_class(size: Column) -> Column:
    """Sizes that differ by less than a factor of two."""
    return F.floor(F.log2(size + 1)).cast("int")


def draw_limit(sizes: np.ndarray, share: float, luck: float) -> tuple[int, float]:
    """(n, words of the first n bins) for a share in words; between two bins the nearer is the likelier, so that the mean is the share."""
    ends = np.append(0.0, np.cumsum(sizes))
    n = int(np.searchsorted(ends, share, "right")) - 1
    if n < 0:
        return 0, 0.0
    if n < len(sizes) and luck * sizes[n] < share - ends[n]:
        n += 1
    return n, float(ends[n])


def limits(bins: DataFrame, seed: int = 1) -> DataFrame:
    """(source, class, upto): bins below ``upto`` get the further copy. ``bins``: (source, class, bin, size, fraction).

    A source is one group of at most ``BINS`` rows for each class, whatever the
    number of its documents.
    """

    def cut(x: pd.DataFrame) -> pd.DataFrame:
        source, fraction = x["source"].iloc[0], float(x["fraction"].iloc[0])
        rng, over, out = np.random.default_rng([seed, zlib.crc32(str(source).encode())]), 0.0, []
        for k, part in sorted(x.groupby("class"), reverse=True):
            part = part.sort_values("bin")
            size = part["size"].to_numpy(np.float64)
            share = min(max(fraction * size.sum() - over, 0.0), size.sum())
            n, took = draw_limit(size, share, rng.random())
            over += took - fraction * size.sum()
            out.append((source, k, int(part["bin"].iloc[n]) if n < len(part) else BINS))
        return pd.DataFrame(out, columns=["source", "class", "upto"])

    return bins.groupBy("source").applyInPandas(cut, f"source {bins.schema['source'].dataType.simpleString()}, class int, upto int")


def _planned(rows: DataFrame, weights: DataFrame | None, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` of (source, class, bin, size), summed or not: the targets of the sources and the limits of their classes."""
    bins = materialise(rows.groupBy("source", "class", "bin").agg(F.sum("size").alias("size")))
    sizes = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(sizes, cyclic_weights(sizes) if weights is None else weights, most=most).withColumnRenamed("source", "of"))
    drawn = bins.join(goal, F.expr("source <=> of")).filter("fraction > 0").select("source", "class", "bin", "size", "fraction")
    return goal, materialise(limits(drawn, seed).withColumnsRenamed({"source": "for", "class": "class_of"}))


def plan(df: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: float = 3.0, seed: int = 1) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row: how often the mix takes it.

    ``weights``: (source, weight) under the name of ``source_col``. Defined cases:
    null texts have size 0; null sources are a source of their own; rows of one
    source that share an id and a class of sizes share the draw and so its outcome,
    also if the id is null; a source of size 0 has target 0 and gives nothing; equal
    sizes are told apart by the hash of the id; an empty table gives no rows. Texts
    count whole. Other columns play no part.
    """
    size = n_words(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), bin_of(seed, F.col(id_col)).alias("bin"))
    rows = materialise(rows.withColumn("class", size_class(F.col("size"))))
    goal, upto = _planned(rows, None if weights is None else weights.withColumnRenamed(source_col, "source"), most, seed)
    x = rows.join(goal, F.expr("source <=> of"), "left").join(upto, F.expr("source <=> `for` and class = class_of"), "left")
    copies = F.col("copies") + F.coalesce((F.col("bin") < F.col("upto")).cast("long"), F.lit(0))
    return x.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(df: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: float = 3.0, seed: int = 1) -> DataFrame:
    """``df`` with each row as often as ``plan`` says, with the columns of ``df``, whatever their names. Its defined cases are those of ``plan``."""
    row = lambda: F.struct(F.col(source_col).alias("source"), size_class(n_words(F.col(text_col))).alias("class"), bin_of(seed, F.col(id_col)).alias("bin"))
    rows = df.select(row().alias("r"), n_words(F.col(text_col)).alias("size")).select("r.*", "size")
    goal, upto = _planned(rows, None if weights is None else weights.withColumnRenamed(source_col, "source"), most, seed)
    drawn, of, copies, source, kind, limit, copy = free_names(df, "drawn", "of", "copies", "for", "class_of", "upto", "copy")
    goal = goal.select(F.col("of").alias(of), F.col("copies").alias(copies))
    upto = upto.select(F.col("for").alias(source), F.col("class_of").alias(kind), F.col("upto").alias(limit))
    x = df.withColumn(drawn, row()).join(goal, F.expr(f"`{drawn}`.source <=> `{of}`")).join(upto, F.expr(f"`{drawn}`.source <=> `{source}` and `{drawn}`.class = `{kind}`"), "left")
    times = F.col(copies) + F.coalesce((F.col(drawn)["bin"] < F.col(limit)).cast("long"), F.lit(0))
    return x.select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(copy)).drop(copy)
