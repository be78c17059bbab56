"""Repeated passages against a scan of all windows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup as sd


def brute(docs, length):
    """{id: (kept, bytes, removed, spans)}; documents in order of id."""
    seen, out = set(), {}
    for i, t in docs:
        text = (t or "").encode()
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (bytes(c for c, g in zip(text, gone, strict=True) if not g), len(text), sum(gone), spans)
    return out


def check(spark, docs, length=100):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(df, length=length).collect()}
    assert got == brute(sorted(docs), length)


@pytest.mark.parametrize(("seed", "length", "alphabet"), [(1, 100, "abcdefgh é"), (2, 20, "ab"), (3, 100, "a"), (4, 37, "xyz\n\0")])
def test_random_texts_with_shared_passages(spark, seed, length, alphabet):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randrange(50, 400)) for _ in range(5)]
    docs = [(k, "".join(x for _ in range(rng.randrange(4)) for x in (text(rng.randrange(150)), rng.choice(shared)[rng.randrange(20) :]))) for k in range(60)]
    check(spark, [*docs, (100, None), (101, "short"), (102, docs[3][1])], length)


def test_small_parts_give_the_same(spark, monkeypatch):
    """Chunks and flushes cut phrases and tables anywhere."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcd ") for _ in range(1500))
    docs = [(k, base[rng.randrange(700) :][: rng.randrange(900)]) for k in range(25)]
    monkeypatch.setattr(sd, "CHUNK", 300)
    monkeypatch.setattr(sd, "FLUSH", 7)
    parser = sd.Parser(100)
    import numpy as np

    data = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(t) for _, t in docs]))
    windows = sum(int(p["n"].sum()) for p in parser.phrases(data, at, np.arange(len(docs))))
    assert windows == sum(max(0, len(t) - 99) for _, t in docs)
    check(spark, docs)


def test_crowded_triggers_are_dealt_by_content(spark, monkeypatch):
    """A short passage in every document, before and behind which all differ: many phrases share its triggers."""
    monkeypatch.setattr(sd, "CROWD", 2)
    monkeypatch.setattr(sd, "FLUSH", 200)
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, long = text(60), text(140)
    docs = [(k, text(90) + common + text(80) + (long if k % 3 == 0 else "") + text(30)) for k in range(90)]
    check(spark, docs + [(200 + k, docs[k][1]) for k in range(0, 90, 7)])


def test_ids_that_are_no_numbers_are_put_in_order(spark):
    a = "".join(map(str, range(120)))
    df = spark.createDataFrame([("b", a, 1), ("a", "x" + a, 2), (None, a, 3), ("c", None, 4)], "doc_id string, text string, i int").withColumns({"doc": F.lit(0), "of": F.lit(0), "spans": F.lit(0), "g": F.lit(0), "digest": F.lit(0), "kept": F.lit(7)})
    cut = sd.without_repeats(df)
    assert cut.columns == df.columns
    assert {r.i: (r.text, r.kept) for r in cut.collect()} == {1: ("", 7), 2: ("x" + a, 7), 3: ("", 7), 4: ("", 7)}


def test_repeated_rows_ids_nulls_and_clashing_columns(spark):
    a, b = "".join(map(str, range(200))), "".join(map(str, range(200, 400)))
    rows = [(1, a, "p"), (1, a, "q"), (1, b, None), (None, a + "!", "r"), (2, b + a, "s"), (3, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("n_spans", F.lit("x"))
    got = sorted(((r.doc_id, r.doc, r.n_removed) for r in sd.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, "p", 0), (1, "q", 0), (1, None, 0), (None, "r", len(a)), (2, "s", len(a + b)), (3, "t", 0)], key=str)
    cut = sd.without_repeats(df)
    assert cut.columns == df.columns
    assert {r.doc: r.text for r in cut.collect()}["r"] == "!"
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_characters_cut_in_part_leave_no_bad_bytes(spark):
    a = "é" * 100
    df = spark.createDataFrame([(1, "x" + a), (2, "y" + a[:60] + "z")], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in sd.without_repeats(df, length=99).collect()}
    assert all("�" not in t for t in texts.values())
    assert texts[2].startswith("y") and texts[2].endswith("z")
