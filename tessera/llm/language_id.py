"""Language identification as inference of a mixture of languages.

Each language is a distribution over hashed byte 4-grams, learned by counting. A
document is cut into segments; each segment comes from one language of the
document's set, and expectation-maximisation estimates the proportions. The set
grows while the log likelihood gains more than a penalty for a further language.

A text whose 4-grams no learned language makes likelier than chance is in none of
them; ``lang_gain`` tells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_batches, raw_bytes, slices

NGRAM, BUCKETS, SEGMENT, ROUNDS = 4, 1 << 16, 64, 8
UNKNOWN = "und"
_MADE = {"lang_pred": "string", "lang_score": "double", "lang_set": "string", "lang_gain": "double"}
#: ASCII letters in lower case; other ASCII is a space; bytes of longer characters stay.
_FOLD = np.array([c if c > 127 else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of the 4-gram at each byte; BUCKETS where it would leave its text or is blank."""
    x = np.append(_FOLD[data], np.full(NGRAM - 1, 32, np.uint32))
    code = x[: len(data)].copy()
    for k in range(1, NGRAM):
        code |= x[k : len(data) + k] << np.uint32(8 * k)
    out = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    out[code == 0x20202020] = BUCKETS
    for k in range(1, NGRAM):
        ends = at[1:] - k
        out[ends[ends >= at[:-1]]] = BUCKETS
    return out


class Model:
    """log probability of each bucket in each language, less its mean over languages; a blank has none.

    ``chance``: that mean, over that of a bucket drawn by chance, and 1 for each gram.
    """

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        logp = np.log(smooth / smooth.sum(1, keepdims=True)) if len(languages) else np.zeros((0, BUCKETS))
        # Overlapping grams repeat each other's evidence.
        self.table = np.ascontiguousarray(np.append(logp.T - logp.mean(0)[:, None] if len(languages) else logp.T, np.zeros((1, len(languages))), 0) / NGRAM, np.float32)
        mean = np.append(logp.mean(0) + np.log(BUCKETS) if len(languages) else np.zeros(BUCKETS), 0.0)
        self.chance = np.stack([mean, np.append(np.ones(BUCKETS), 0.0)], 1)

    def mixtures(self, data: np.ndarray, at: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(proportions: texts x languages, posterior of each language were it the only one, gain over chance by gram with the best language of each segment)."""
        n, size = len(at) - 1, np.diff(at)
        share, alone, gain = np.zeros((n, len(self.languages))), np.zeros((n, len(self.languages))), np.zeros(n)
        full = np.flatnonzero(size > 0)
        if not len(full) or not self.languages:
            return share, alone, gain
        parts = -(-size[full] // SEGMENT)
        first = np.append(0, np.cumsum(parts))
        start = np.repeat(at[full] - SEGMENT * first[:-1], parts) + SEGMENT * np.arange(first[-1])
        found = grams(data, at)
        ll = np.add.reduceat(self.table[found], start, axis=0).astype(np.float64)
        chance = np.add.reduceat(self.chance[found], at[full], axis=0)
        total = np.add.reduceat(ll, first[:-1], axis=0)
        alone[full] = _softmax(total)
        share[full, total.argmax(1)] = 1.0
        active = share[full] > 0
        top = ll.max(1)
        have, bound = total.max(1), np.add.reduceat(top, first[:-1])
        gain[full] = (NGRAM * bound + chance[:, 0]) / np.maximum(chance[:, 1], 1)
        grow = np.arange(len(full))
        cost = penalty + 0.5 * np.log(parts)
        while len(grow := grow[bound[grow] - have[grow] > cost[grow]]) and active[grow[0]].sum() < len(self.languages):
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in grow])
            edge = np.append(0, np.cumsum(parts[grow]))
            odds = np.exp(ll[rows] - top[rows, None])
            best, found, what = np.full(len(grow), -np.inf), np.zeros((len(grow), len(self.languages))), np.zeros(len(grow), np.int64)
            for lang in range(len(self.languages)):
                tried = active[grow].copy()
                tried[:, lang] = True
                pi, value = _em(odds, edge, parts[grow], tried)
                value = np.where(active[grow, lang], -np.inf, value + bound[grow])
                better = value > best
                best[better], found[better], what[better] = value[better], pi[better], lang
            took = best - have[grow] > cost[grow]
            grow, best, found, what = grow[took], best[took], found[took], what[took]
            have[grow], share[full[grow]], active[grow, what] = best, found, True
        return share, alone, gain


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _em(odds: np.ndarray, edge: np.ndarray, parts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the active languages and the log likelihood (less that of each segment's best language)."""
    pi = active / active.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        got = odds * np.repeat(pi, parts, axis=0)
        got /= got.sum(1, keepdims=True) + 1e-30
        pi = np.add.reduceat(got, edge[:-1], axis=0) / parts[:, None]
    value = np.log((odds * np.repeat(pi, parts, axis=0)).sum(1) + 1e-30)
    return pi, np.add.reduceat(value, edge[:-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 0 modulo 5; a null id is not held out, and is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000) -> Model:
    """Count n-grams over a sample, by hash of the id, of about ``per_language`` labelled rows of each language that are not held out.

    The counts that reach the driver are one number for each language and bucket
    of the sample, whatever the size of the corpus.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    drawn = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.filter(drawn < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = raw_bytes(batch.column(1))
                lang = np.searchsorted(languages, batch.column(0).to_pylist())
                key = grams(data, at) * len(languages) + np.repeat(lang, np.diff(at))
                key, n = np.unique(key[key < BUCKETS * len(languages)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counts = np.zeros(BUCKETS * len(languages))
    found = map_batches(rows, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts[found["key"].to_numpy(np.int64)] = found["n"]
    return Model(languages, counts.reshape(BUCKETS, -1).T)


def identify(df: DataFrame, model: Model, text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """``df`` with lang_pred, lang_score (0 to 1), lang_set (comma-joined, by proportion) and lang_gain of each whole text.

    lang_pred has the largest proportion; ties go to the first by name. The score
    is its proportion times its posterior as the only language. lang_gain is by how
    much the languages make a 4-gram likelier than chance does, in its logarithm on
    average: at most 0, the text is in no language that was learned. Defined cases:
    a null or empty text or one without a letter is ``und`` with score 0, an empty
    set and no gain, and so is any text if nothing was learned; repeated rows and
    ids get the same result each; an empty table gives no rows. Columns of these
    names in ``df`` are replaced, others stay.
    """
    made = _MADE
    df = df.drop(*made)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                column = batch.column(text_col)
                share, alone, gain = model.mixtures(*raw_bytes(column), penalty)
                best = share.argmax(1) if model.languages else np.zeros(len(share), np.int64)
                ok = [bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()]
                pred = [model.languages[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
                score = [float(share[k, b] * alone[k, b]) if ok[k] else 0.0 for k, b in enumerate(best)]
                sets = [",".join(model.languages[j] for j in np.argsort(-s, kind="stable") if s[j] > 0) if o else "" for s, o in zip(share, ok, strict=True)]
                names = [*batch.schema.names, *made]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string()), pa.array(np.where(ok, gain, 0.0))], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {v}" for k, v in made.items()])
    return map_batches(df, run, schema)


def keep_identified(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are in a language that was learned, with the columns of ``df``; a null label becomes the one found.

    Null and empty texts, texts without a letter, and texts that no language makes
    likelier than chance are rejected. If nothing was learned, only the former are.
    Repeated rows stay or go together.
    """
    if not model.languages:
        return df.filter(F.col(text_col).rlike(r"\p{L}"))
    clash = {c: c2 for c, c2 in zip(_MADE, free_names(df, *[f"own_{c}" for c in _MADE]), strict=True) if c in df.columns}
    found = identify(df.withColumnsRenamed(clash), model, text_col).filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_gain") > 0))
    if lang_col in df.columns:
        found = found.withColumn(lang_col, F.coalesce(lang_col, F.col("lang_pred")))
    return found.drop(*_MADE).withColumnsRenamed({v: k for k, v in clash.items()}).select(*df.columns)
