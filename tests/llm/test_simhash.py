"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm import simhash as sh
from tessera.llm.common import components


def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprint_counts_each_shingle():
    text = b"The cat  sat\ton THE mat the cat sat"
    words = text.lower().split()
    bits = np.zeros(64, int)
    for k in range(len(words) - 2):
        h = xxh64_intdigest(b" ".join(words[k : k + 3]), 42)
        bits += [h >> b & 1 for b in range(64)]
    assert sh.fingerprint(text) == sum(1 << b for b in range(64) if 2 * bits[b] > len(words) - 2)
    assert sh.fingerprint(b" \n") == 0
    assert sh.fingerprint(b"Two words") == xxh64_intdigest(b"two words", 42)


@pytest.mark.parametrize("few", [sh.PAIRS_UP_TO, 0])
def test_links_reach_the_components_of_all_pairs(spark, few, monkeypatch):
    """With pairs only, and with neighbour keys only."""
    monkeypatch.setattr(sh, "PAIRS_UP_TO", few)
    rng, fps = random.Random(5), set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.choice((0, 1, 6))):
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    pairs = [(a, b) for a in range(len(signed)) for b in range(a) if ((signed[a] ^ signed[b]) & (2**64 - 1)).bit_count() <= 2]
    want = {signed[k]: signed[r] for k, r in enumerate(roots(len(signed), pairs)) if k != r}
    got = components(sh.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2))
    assert {r.node: r.root for r in got.collect()} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    long = "word " * 30000
    rows = [(5, None, "x"), (4, "", None), (3, " \n", "y"), (2, long, "z"), (1, long.upper(), "z"), (1, long.upper(), "z"), (None, long, None), (9, "quite another text here", "fp")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "id")
    got = sorted(((r.id, r.component) for r in sh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (4, 3), (3, 3), (2, 1), (1, 1), (1, 1), (None, 1), (9, 9)], key=str)
    kept = sh.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 1, 1, None, 9], key=str)
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_copies_in_thousands_are_one_class(spark):
    rows = [(k, "the same text in every row of this group") for k in range(3000)] + [(5000 + k, f"text number {k} with words {k * 7}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component for r in sh.near_duplicates(df).filter("id < 5000").collect()} == {0}


def test_similar_texts_are_grouped_and_others_left_alone(spark):
    """Copies with one word in 120 changed share over 0.8 of their five-word shingles; texts that share half do not count."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows, groups = [], {}
    for k in range(40):
        base = [rng.choice(words) for _ in range(240)]
        for c in range(rng.choice((1, 2, 5, 12))):
            text = list(base)
            for _ in range(2 if c else 0):
                text[rng.randrange(240)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
            groups.setdefault(k, []).append(rows[-1][0])
        rows.append((len(rows), " ".join(base[:150] + [rng.choice(words) for _ in range(110)])))
        groups[f"half {k}"] = [rows[-1][0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r.component for r in sh.similar(df).collect()}
    alone = [i for name, ids in groups.items() if isinstance(name, str) for i in ids]
    assert all(got[i] == i for i in alone)
    wrong = sum(got[i] != ids[0] for name, ids in groups.items() if not isinstance(name, str) for i in ids)
    assert wrong <= 0.05 * len(rows)
    assert all(got[i] in ids for ids in groups.values() for i in ids)


def test_similar_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None), (4, " "), (3, "Three words here"), (2, "three  words HERE"), (2, "three  words HERE"), (None, "three words here"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("f0", F.lit("x"))
    got = sorted(((r.id, r.component) for r in sh.similar(df).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (3, 2), (2, 2), (2, 2), (None, 2), (9, 9)], key=str)
    kept = sh.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 2, 2, None, 9], key=str)
    assert sh.similar(df.limit(0)).count() == 0


def test_pairs_about_the_threshold_are_judged_by_their_shingles(spark):
    """Two texts each, at 0.6 to 0.95: those linked are at 0.8 or more, and nearly all of those are linked."""
    rng = random.Random(3)
    words, rows, want = [f"w{k}" for k in range(3000)], [], {}
    for k in range(400):
        base = [rng.choice(words) for _ in range(200)]
        other = base[: rng.randrange(150, 197)]
        other += [rng.choice(words) for _ in range(200 - len(other))]
        a, b = ({tuple(x[i : i + 5]) for i in range(196)} for x in (base, other))
        want[2 * k + 1] = 9 * len(a & b) >= 4 * (len(a) + len(b))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    rows += [(2 * 400, "x"), (2 * 400, "y")]
    got = {r.id: r.component for r in sh.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    linked = {i for i in want if got[i] != i}
    assert all(want[i] for i in linked)
    assert len(linked) >= 0.9 * sum(want.values()) > 100


def similar_pairs(texts, width=5):
    """All pairs at 0.8 or more, by brute force."""
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))})
    return [(a, b) for a in range(len(sets)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]


def groups_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.id: r.component for r in sh.similar(df).collect()}
    return [got[k] for k in range(len(texts))]


def test_every_pair_at_the_threshold_is_found(spark):
    """Pairs alone in their group, most of them at 0.78 to 0.86."""
    rng, texts = random.Random(12), []
    words = [f"w{k}" for k in range(3000)]
    for _ in range(300):
        base = [rng.choice(words) for _ in range(200)]
        cut = rng.randrange(174, 186)
        texts += [" ".join(base), " ".join(base[:cut] + [rng.choice(words) for _ in range(200 - cut)])]
    pairs = similar_pairs(texts)
    assert len(pairs) > 100
    assert groups_of(spark, texts) == roots(len(texts), pairs)


def test_pairs_inside_a_large_family_are_found(spark, monkeypatch):
    """Near copies among texts that share 60 to 87 % boilerplate, whose buckets take several blocks."""
    monkeypatch.setattr(sh, "BLOCK", 8)
    monkeypatch.setattr(sh, "NAMED", 0)
    rng, texts = random.Random(13), []
    words = [f"w{k}" for k in range(5000)]
    for share in (60, 70, 80, 87):
        boilerplate = [rng.choice(words) for _ in range(share)]
        for _ in range(60):
            base = boilerplate + [rng.choice(words) for _ in range(104 - share)]
            cut = rng.randrange(90, 99)
            texts += [" ".join(base), " ".join(base[:cut] + [rng.choice(words) for _ in range(104 - cut)])]
    rng.shuffle(texts)
    pairs = similar_pairs(texts)
    assert len(pairs) > 150
    assert groups_of(spark, texts) == roots(len(texts), pairs)
    monkeypatch.undo()
    assert groups_of(spark, texts) == roots(len(texts), pairs)


def test_short_near_copies_are_found(spark):
    """Texts of 1 to 14 words and copies with one word more: 0.8 from 4 against 5 shingles on, less below."""
    rng, texts = random.Random(14), []
    words = [f"w{k}" for k in range(3000)]
    for k in range(280):
        base = [rng.choice(words) for _ in range(1 + k % 14)]
        texts += [" ".join(base), " ".join([*base, rng.choice(words)])]
    pairs = similar_pairs(texts)
    assert len(pairs) >= 140
    assert groups_of(spark, texts) == roots(len(texts), pairs)


def test_texts_without_ids_are_compared_too(spark):
    """A text without an id links two that are at less than 0.8 of each other."""
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words[:100])), (None, " ".join(words[:112])), (2, " ".join(words[:125])), (3, " ".join(words[200:]))]
    got = {(r.id, r.component) for r in sh.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(similar_pairs([t for _, t in rows])) == 2
    assert got == {(1, 1), (None, 1), (2, 1), (3, 3)}
