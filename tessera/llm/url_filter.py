"""URL filters: pattern rules behind an index of their rarest literal token.

Each rule names literal tokens that every URL it matches must hold. It is indexed
under the one that the fewest URLs hold; a URL's tokens fetch candidate rules, and
only their regular expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

ALLOW, BLOCK = "allow", "block"
_TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` stand whole in any match; the longest ``name`` wins among ``listed`` rules."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def site(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start with ``path``."""
    whole = f"{host}{path}"
    found = list(_TOKEN.finditer(whole))
    # The last token may go on in the URL if the path ends within it.
    tokens = tuple(m[0] for m in found if m.end() < len(whole))
    return Rule(whole, verdict, rf"\A(?:[^/]*\.)?{re.escape(whole)}", tokens, True)


def word(text: str) -> Rule:
    """Block URLs that hold these words, one after another, between other signs."""
    tokens = tuple(text.split())
    return Rule(text, BLOCK, r"(?<![A-Za-z0-9])" + r"[-._]".join(map(re.escape, tokens)) + r"(?![A-Za-z0-9])", tokens)


#: The listed sites.
SITES = (
    site("com", "/", ALLOW),
    site("example.com", "/en/", BLOCK),
    site("www.example.com", "/en/", ALLOW),
    site("net", "/es/", BLOCK),
    site("net", "/fr/", BLOCK),
)
#: Words of unwanted sites, for URLs that no listed site covers.
WORDS = tuple(map(word, ("spam", "spam farm", "cheap pills", "online casino", "casino", "free porn", "porn", "xxx", "viagra", "payday loans", "warez", "phishing")))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Index:
    """Rules by rarest token. ``counts``: in how many URLs each token stands."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            put = self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []) if rule.tokens else self.always
            put.append((rule, re.compile(rule.pattern)))

    def matches(self, key: str) -> list[Rule]:
        tokens = set(_TOKEN.findall(key))
        candidates = self.always + [x for t in tokens if t in self.by_token for x in self.by_token[t]]
        return [rule for rule, pattern in candidates if pattern.search(key)]


def token_counts(df: DataFrame, key: Column, tokens: list[str]) -> dict[str, int]:
    """In how many keys each of ``tokens`` stands: one row for each token of the rules reaches the driver."""
    own = F.array_intersect(F.regexp_extract_all(key, F.lit("([A-Za-z0-9]+)")), F.array(*map(F.lit, tokens)))
    return {r["t"]: r["n"] for r in df.select(F.explode(own).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = SITES + WORDS) -> DataFrame:
    """``df`` with host, path, rule, verdict and words: the listed rule that fits best, or null, and the verdict.

    Of the listed rules that fit, the longest name wins. Where none fits, the URL
    is blocked if another rule matches (``words`` names the longest) or if it has
    no host, and allowed otherwise. A null URL has no host. Every row gives a row;
    columns of these names in ``df`` are replaced. The rules are a list that the
    driver holds; it goes to the tasks whole.
    """
    made = ("host", "path", "rule", "verdict", "words")
    df = df.drop(*made)
    df = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    index = Index(rules, token_counts(df, F.concat("host", "path"), sorted({t for r in rules for t in r.tokens})))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{c} string" for c in made[2:]])

    def run(batches):
        for batch in batches:
            rows = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = sorted(index.matches(host + path), key=lambda r: (len(r.name), r.name))
                listed, other = [r for r in found if r.listed], [r for r in found if not r.listed]
                rows.append((listed[-1].name if listed else None, listed[-1].verdict if listed else BLOCK if other or not host else ALLOW, other[-1].name if other and not listed else None))
            arrays = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *made[2:]])

    return map_batches(df, run, schema)
