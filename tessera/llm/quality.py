"""Quality rules as a short-circuit cascade.

A sample gives each rule's cost and the share it rejects; rules then run by
rejection per cost, and the first that fails ends the cascade. Each rule pays for
statistics of its own when it runs, so those behind a failure cost nothing. The
verdict is the conjunction of all rules, so the order changes its cost only.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

#: ASCII white space and the symbols that are counted.
WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Features:
    """The statistics of one text, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        counts = Counter(windows)
        again = np.fromiter((counts[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def n_bare_words(self) -> int:
        """Words without a letter: all are ASCII and none is from A to Z."""
        return sum(_LETTER.search(w) is None for w in self.words)

    @cached_property
    def n_bullets(self) -> int:
        return sum(line.strip().startswith((b"*", b"-", "•".encode())) for line in self.lines)

    @cached_property
    def n_cut_lines(self) -> int:
        return sum(line.strip().endswith((b"...", "…".encode())) for line in self.lines)

    @cached_property
    def top_pair_chars(self) -> int:
        """The most characters that the places of one pair of neighbouring words hold."""
        words = [w.decode() for w in self.words]
        return max((n * (len(a) + len(b)) for (a, b), n in Counter(zip(words, words[1:], strict=False)).items()), default=0)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Features], bool]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: Beyond the base: symbols for over 3 in 10 words, over half the lines repeat, words of unlikely length, over a fifth of
#: the words without a letter, over 9 in 10 lines are list items, over 3 in 10 lines are cut off, one pair of words holds over a fifth of all characters.
MORE_RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
    Rule("short_words", lambda f: 2 * f.word_chars < 5 * f.n_words),
    Rule("long_words", lambda f: f.word_chars > 15 * f.n_words),
    Rule("bare_words", lambda f: 5 * f.n_bare_words > f.n_words),
    Rule("bullets", lambda f: 10 * f.n_bullets > 9 * f.n_lines),
    Rule("cut_lines", lambda f: 10 * f.n_cut_lines > 3 * f.n_lines),
    Rule("one_pair", lambda f: 5 * f.top_pair_chars > f.word_chars),
)


def order(df: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample: int = 1000, show: tuple[str, ...] = (), base: tuple[Rule, ...] = ()) -> list[Rule]:
    """The rules by rejected share per second, measured on about ``sample`` rows drawn by their place; ties by name.

    The sample steers cost only; copies of one text are drawn one by one. Each rule is
    timed as the cascade would run it first: on rows that no rule of ``base`` rejects,
    and with the features of ``show`` and of the base rules there already, so that a
    rule which needs nothing more is nearly free. An empty table gives the rules by name.
    """
    total = df.count()
    share = min(1.0, sample / max(1, total))
    drawn = df.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place")).filter(F.pmod(F.xxhash64("place"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")

    def run(batches):
        spent, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                known = Features(text)
                for c in show:
                    getattr(known, c)
                if any([r.fails(known) for r in base]):
                    continue
                for k, rule in enumerate(rules):
                    own = Features(text)
                    vars(own).update(vars(known))
                    began = time.perf_counter()
                    rejected[k] += bool(rule.fails(own))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "spent": spent, "rejected": rejected})

    found = map_batches(drawn, run, "rule string, spent double, rejected long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"))
    worth = {r["rule"]: r["rejected"] / max(r["spent"], 1e-9) for r in found.collect()}
    return sorted(rules, key=lambda r: (-worth.get(r.name, 0.0), r.name))


def cascade(df: DataFrame, rules: list[Rule] | tuple[Rule, ...], text_col: str = "text", show: tuple[str, ...] = (), base: tuple[Rule, ...] = ()) -> DataFrame:
    """``df`` without its text, with the features of ``show`` (long), base_failed and kept.

    base_failed: a rule of ``base`` fails. kept: neither a base rule nor one of
    ``rules`` fails; ``rules`` run in the given order up to the first that fails,
    and not at all after a base rule failed. Only statistics that ``show`` names or
    that a rule asks for are computed. Defined cases: a null or empty text has no
    words, lines or symbols; texts count whole; repeated rows and ids get the same
    result each; an empty table gives no rows. Columns of these names in ``df`` are
    replaced, others stay.
    """
    df = df.drop(*show, "base_failed", "kept")
    rest = [f for f in df.schema if f.name != text_col]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                shown, failed, kept = [], [], []
                for text in batch.column(text_col).to_pylist():
                    f = Features(text)
                    shown.append([getattr(f, c) for c in show])
                    failed.append(any(r.fails(f) for r in base))
                    kept.append(not failed[-1] and not any(r.fails(f) for r in rules))
                arrays = [pa.array([s[k] for s in shown], pa.int64()) for k in range(len(show))]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *arrays, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=[*(f.name for f in rest), *show, "base_failed", "kept"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{c} long" for c in show] + ["base_failed boolean", "kept boolean"])
    return map_batches(df, run, schema)
