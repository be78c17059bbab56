"""Top-k search, URL filters and archives, against plain Python."""

import gzip
import hashlib
import io
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk, url_filter, warc
from tessera.llm.queries import ORACLE_SQL

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, queries, k):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q in queries:
        if q in usable:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, rows, every=10, k=10):
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).repartition(3)
    got = topk.top_k(df, df.filter(F.col("vec_id") % every == 0), k=k)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [topk.BLOCK, 37])
def test_top_k_equals_all_scores(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)) * rng.choice([0.1, 1, 5], size=(300, 1))
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    rows += [(300 + k, rows[0][1], None) for k in range(40)]
    assert search(spark, rows) == brute_top(rows, range(0, 340, 10), 10)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [math.nan, 1.0], 1), (40, [math.inf, 0.0], 1), (50, [], 1), (60, [3.0], 1), (61, [-1.0, -1.0, 4.0], 1), (None, [1.0, 1.0], 1), (70, [1e30, 0.0], 1)]
    got = search(spark, rows)
    assert [r[2] for r in got if r[0] == 0] == [70, 60, 50, 61]
    assert got == [r for r in got if r[0] in (0, 50, 60, 70)]
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], 1)]) == []


def test_components_and_sums_of_any_size(spark):
    """Components past 2**28, sums past 2**53 and past 2**63 are told apart; only the returned score ends at 64 bits."""
    rows = [(k, [2.0 ** (18 + k % 3), 2.0 ** (16 + k % 5), float(k % 7)], 0) for k in range(60)]
    rows += [(100 + k, [float(np.float32(2.0**36 + 2.0**14 * k)), 1.0, -1.0], 0) for k in range(9)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id in (0, 7, 100)"), k=12).collect()))
    most = (1 << 63) - 1
    want = [(q, r, i, min(s, most)) for q, r, i, s in brute_top(rows, (0, 7, 100), 12)]
    assert got == want
    assert any(s == most for *_, s in want) and any(2**53 < s < most for *_, s in want)
    huge = [(0, [1e30, 1.0], 0), (1, [1e30, 5.0], 0), (2, [2e30, 0.0], 0), (3, [-3e30, 1.0], 0), (4, [-1e30, 1.0], 0), (5, [1.0, 1.0], 0)]
    assert [r.vec_id for r in topk.top_k(spark.createDataFrame(huge, VECTORS), spark.createDataFrame(huge[:1], VECTORS)).orderBy("rank").collect()] == [2, 1, 5, 4, 3]


@pytest.mark.parametrize("held", [1, 1 << 26])
def test_groups_of_blocks_carry_the_score_on(spark, held, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(rng.normal(size=(400, 6)) * rng.choice([0.1, 1, 30], size=(400, 1)))]
    assert search(spark, rows, 5, 7) == brute_top(rows, range(0, 400, 5), 7)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert search(spark, rows, 5, 7) == brute_top(rows, range(0, 400, 5), 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("block", [topk.BLOCK, 5])
def test_repeated_rows_equal_their_sql(spark, block, monkeypatch):
    """Candidates and queries that repeat an id, with one vector or several, are rows of their own; a query leaves out nothing but itself."""
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(size=4)], 0) for k in range(60)]
    rows += [rows[5]] * 3 + [rows[0]] * 2 + [(0, rows[7][1], 0), (100, rows[0][1], 0), (100, rows[0][1], 0), (200, rows[5][1], 0)]
    table = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", table)
    want = con.execute(ORACLE_SQL["op3_topk"]).fetchall()
    assert search(spark, rows, 100) == sorted(want) and len(want) == 70


def test_the_index_prunes_by_proof():
    """On skewed impacts most candidates are left out before the exact scores."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 8)) * 1000 * np.array([8, 4, 2, 1, 0.5, 0.2, 0.1, 0.1])).astype(np.int64)
    index, q = topk.Block(np.arange(4000), x), x[0]
    ids, scores = index.search(0, q, 10)
    exact = x @ q
    exact[0] = -(1 << 60)
    want = np.lexsort((np.arange(4000), -exact))[:10]
    assert list(ids) == list(want) and list(scores) == list(exact[want])


# --- URLs ---

URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "https://www.example.com/en/a", "http://sub.www.example.com/en/", "http://example.com/en", "http://a.net/es/1", "http://a.net/esx", "http://net/fr/", "http://anet/fr/",
        "ftp://com/", "http://com", "http://x.com", "http://x.com:80/", "http://spam-farm.org/", "http://spam-farm.com/", "http://www.cheap-pills.org/a", "http://cheappills.org/", "a://b://c/d", "http://x.org/casino", "http://x.org/casinos", "http://ÄÖ.com/é", "http://q.net?/es/", "http://u\nv.com/\n", "HTTP://X.NET/fr/"]


def brute_verdict(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None))


def test_urls_against_a_scan_of_all_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id long, url string").withColumn("verdict", F.lit(5))
    got = sorted(url_filter.judge(df).collect(), key=lambda r: r.page_id)
    assert len(got) == len(URLS) + 3
    for r, url in zip(got, URLS, strict=False):
        host, path, rule, verdict = brute_verdict(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        words = [w for w in url_filter.WORDS if re.search(w.pattern, host + path)]
        assert r.verdict == (verdict or ("block" if words or not host else "allow")), url
    assert url_filter.judge(df.limit(0)).count() == 0


def test_the_index_uses_the_rarest_token_and_runs_few_patterns():
    rules = [url_filter.site("example.com", "/en/", "block"), url_filter.word("cheap pills"), url_filter.Rule("any", "block", "zz", ())]
    index = url_filter.Index(rules, {"com": 90, "example": 50, "en": 70, "cheap": 1, "pills": 2})
    assert set(index.by_token) == {"example", "cheap"} and [r.name for r, _ in index.always] == ["any"]
    assert url_filter.site("a.com", "/pre", "block").tokens == ("a", "com")


# --- archives ---


def test_archive_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (4, "http://c/", "short"), (6, "ü", "short"), (1, "http://d/", None), (2, "http://e/", ""), (3, "http://again/", big), (None, "http://f/", big), (8, "http://g/", "x" * 300000), (7, "h", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(4)
    folder = str(tmp_path / "warc")
    index = warc.write(df, folder)
    got = warc.read(index, folder).collect()
    assert sorted((str(r.page_id), r.url or "", r.record_type, r.refers_to) for r in got) == sorted((str(i), u or "", "revisit" if i in (5, 9) else "response", 3 if i in (5, 9) else None) for i, u, _ in rows)
    for r in got:
        want = next((h or "").encode() for i, u, h in rows if (i, u) == (r.page_id, r.url))
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == want
    whole = b"".join(gzip.decompress(open(f"{folder}/{f}", "rb").read()) for f in os.listdir(folder) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC-Type: revisit") == 2 and whole.count(b"WARC-Refers-To: ") == 2
    one = index.filter("page_id = 8").collect()[0]
    with open(f"{folder}/{one.file}", "rb") as f:
        f.seek(one.offset)
        member = gzip.GzipFile(fileobj=io.BytesIO(f.read(one.length))).read()
    assert member.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and member.endswith(b"x\r\n\r\n")
    assert warc.read(index.filter("page_id in (4, 6)"), folder).count() == 2
    assert warc.archive(df.limit(0)).count() == 0


def test_neighbouring_ranges_are_read_at_once(spark, tmp_path, monkeypatch):
    """With reads of any size the records are the same."""
    rng = random.Random(1)
    df = spark.createDataFrame([(k, f"http://x/{k}", rng.randbytes(rng.randrange(3000)).hex()) for k in range(200)], "page_id long, url string, html string").coalesce(2)
    index = warc.write(df, str(tmp_path / "a"))
    want = {r.page_id: bytes(r.payload) for r in warc.read(index, str(tmp_path / "a")).collect()}
    assert len(want) == 200
    monkeypatch.setattr(warc, "READ", 10_000)
    monkeypatch.setattr(warc, "GAP", 0)
    assert {r.page_id: bytes(r.payload) for r in warc.read(index.filter("page_id % 3 = 0"), str(tmp_path / "a")).collect()} == {k: v for k, v in want.items() if k % 3 == 0}


def test_a_changed_record_is_an_error(spark, tmp_path):
    record = warc.record(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), None, "1970-01-01T00:00:00Z")
    fields, payload = warc.parse(record)
    assert payload == b"abc" and fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}"
