"""Chat formatting, source divergence and hard negatives, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, divergence, hard_negatives
from tessera.llm.common import materialise

# --- chats ---------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, part string, N_TURNS int"


def plain_format(turns):
    """(formatted text, spans of assistant texts) of one conversation."""
    out, spans = "", []
    control = lambda s: re.sub(r"\\|### |<turn>|</turn>", lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", s)
    for role, text in turns:
        out += f"### {control(role)}<turn>"
        if role == "assistant":
            spans.append((len(out), len(out) + len(control(text))))
        out += f"{control(text)}</turn>\n"
    return out, spans


def plain_read(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(plain_format(turns)[0])


def by_conversation(rows):
    """Turns in order; nulls first."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:3])] for conv, turns in found.items()}


def odd_turns():
    rng = random.Random(4)
    pieces = ["\\", "#", "##", "### ", "<", "<turn>", "</turn>", "</turn>\n", "\\### ", "<\\turn>", "é", "日本", "\U0001f600", " ", "\n", "ok", ""]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "", None, "### a<turn>", "x\ny"]), None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randrange(9)))) for conv in range(30) for turn in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "of no one"), (None, 0, "assistant", "first"), (77, None, "assistant", "b"), (77, 0, "assistant", "c"), (78, 1, "assistant", "twice"), (78, 1, "assistant", "twice"), (79, 2, "assistant", None)]
    return rows


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], TURNS)


def test_chats_read_back_as_they_were(spark):
    rows = odd_turns()
    parts = materialise(chat_format.format_chat(chats(spark, rows).repartition(5)))
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_chat(parts).collect()}
    want = by_conversation(rows)
    assert got == {conv: plain_read(turns) for conv, turns in want.items()}
    made = defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: r.part):
        made[r.conv_id].append((r.formatted, [(s.start, s.stop) for s in r.loss]))
    assert {conv: p[0] for conv, p in made.items() if len(p) == 1} == {conv: plain_format(t) for conv, t in want.items() if len(made[conv]) == 1}
    assert sum(len(p) == 1 for p in made.values()) > 20


def test_a_long_conversation_has_several_parts(spark):
    """One conversation holds most of the text, and one turn is longer than a batch."""
    rows = [(5, k, "assistant" if k % 2 else "user", f"é{k} \\</turn>" * 3000) for k in range(200)] + [(6, 0, "assistant", "x<turn>" * 1_500_000), (7, 0, "user", "")]
    parts = materialise(chat_format.format_chat(chats(spark, rows)))
    assert parts.filter("conv_id = 5").count() > 3
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_chat(parts).collect()}
    assert got == {conv: plain_read(turns) for conv, turns in by_conversation(rows).items()}


def test_chats_of_an_empty_table_and_of_broken_text(spark):
    assert chat_format.read_chat(materialise(chat_format.format_chat(chats(spark, [])))).count() == 0
    for text in ("### user<turn>a", "### user<turn>a</turn>", "a", "### a<turn>b</turn>\n### c<turn>", "<turn>### </turn>\n"):
        data = np.frombuffer(text.encode(), np.uint8)
        with pytest.raises(ValueError):
            chat_format.turns_of(data, np.array([0, len(data)]))


# --- divergence ----------------------------------------------------------------------

DOCS = "doc_id long, lang string, source string, text string, term string, n int"


def plain_divergence(rows, least=10, top=10):
    docs = [(lang or "", source or "", [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for la, _, ws in docs if la == lang for w in set(ws))
        vocabulary = {w for w, n in df.items() if n >= least}
        counts = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, ws in docs:
            if la == lang:
                counts[s].update(w for w in ws if w in vocabulary)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(vocabulary))
        apart = lambda a, b, w: (p(a, w) - p(b, w)) ** 2 // (p(a, w) + p(b, w))
        ranked = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
        for s, own in counts.items():
            out += [(lang, s, "pair", item, v, r) for r, (item, v) in ranked([(o, sum(apart(own, other, w) for w in vocabulary)) for o, other in counts.items() if o != s])]
            out += [(lang, s, "term", item, v, r) for r, (item, v) in ranked([(w, apart(own, whole, w)) for w in vocabulary if own[w] and p(own, w) > p(whole, w)]) if r <= top]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "über", "ÜBER", "x1y", "don't", "日本", "a\x00b", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0"] * 5 + [f"s{k}" for k in range(1, 7)] + [None, "é", "Z"]), " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(12)))) for _ in range(n)]
    return rows + [("fr", "only", "rare words here"), ("fr", "none", None), ("xx", "one", "alone"), ("en", "wordless", "123 !!")]


def diverge(spark, rows):
    df = spark.createDataFrame([(k, *r, "clash", 1) for k, r in enumerate(rows)], DOCS).repartition(3)
    return sorted(map(tuple, divergence.divergence(df).collect()))


@pytest.mark.parametrize(("block", "chunk", "stripe"), [(64, 4096, 16), (2, 4, 2), (3, 1, 1)])
def test_divergence_equals_plain_python(spark, block, chunk, stripe, monkeypatch):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("STRIPE", stripe)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(block)
    assert diverge(spark, rows) == plain_divergence(rows)


def test_divergence_of_nothing_and_of_a_long_text(spark):
    assert diverge(spark, []) == []
    rows = [("en", f"s{k % 2}", ("long " * 400_000 if k == 3 else "") + f"long short {'a' if k % 2 else 'b'}") for k in range(40)]
    assert diverge(spark, rows) == plain_divergence(rows)


def test_shares_of_large_counts_are_exact():
    for total in (3, 10**9 + 7, 8 * 10**15):
        counts = [0, 1, total // 3, total - 2]
        assert divergence.scaled(np.array(counts), total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]


# --- hard negatives --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, norm string, PART int"


def plain_negatives(rows, every=10, k_pos=5, k_neg=10):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, clip = [], lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for a, (anchor, q, label) in enumerate(usable):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other == label) for c, (i, v, other) in enumerate(usable) if c != a)
        for s, positive, _ in [x for x in scored if x[2]][:k_pos]:
            fits = [(i, -n) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:k_neg]
            out += [(anchor, positive, r, i, clip(-s), clip(n)) for r, (i, n) in enumerate(fits, 1)]
    return sorted(out)


def mine(spark, rows, every=10):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def near(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 8))
    return [(k, [float(c) for c in (centres[k % 4] + rng.normal(size=8)) * spread[rng.integers(len(spread))]], int(rng.integers(3))) for k in range(n)]


@pytest.mark.parametrize(("bucket", "held", "spread"), [(2048, 32 << 20, [1.0]), (16, 1024, [0.05, 1, 20]), (7, 1, [1, 1, 3])])
def test_negatives_equal_all_scores(spark, bucket, held, spread, monkeypatch):
    for name, value in (("BUCKET", bucket), ("HELD", held), ("ANCHORS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = near(bucket, 260, spread)
    rows += [rows[0]] * 7 + [rows[10], rows[10], rows[11]] + [(300 + k, rows[3][1], 2) for k in range(30)]
    got = mine(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 100


def test_short_norms_are_never_scored(spark, monkeypatch):
    """Buckets that can't reach the limit are left out by their norm alone."""
    monkeypatch.setattr(hard_negatives, "BUCKET", 8)
    ids, book = np.arange(8, dtype=np.int64), {}
    made = [hard_negatives.Bucket(8 * k, ids.tobytes(), ["b"] * 8, np.full((8, 2), size, "<i4").tobytes(), "<i4", size * math.sqrt(2), 8, book) for k, size in enumerate((100, 50, 1))]
    seen = []
    monkeypatch.setattr(hard_negatives.Bucket, "scores", lambda self, q, f=hard_negatives.Bucket.scores: seen.append(self.norm) or f(self, q))
    found = hard_negatives.Search(3, [(9000, 30000, 1)])
    hard_negatives.search(made, [(99, "a", np.array([100, 100]), 100 * math.sqrt(2))], [found], False, book)
    # The second bucket reaches the window's lower end, but not the third score found.
    assert len(seen) == 1 and found.found[0][2].tolist() == [20000] * 3


def test_negatives_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (10, None, 1), (20, [1.0, None], 1), (30, [math.nan, 1.0], 1), (40, [math.inf, 0.0], 1), (50, [], 1), (60, [3.0], 1), (61, [0.5, 0.25, 4.0], 2), (None, [1.0, 1.0], 2), (70, [1.0, 1.5], None), (80, [0.9, 1.1], 2), (90, [-1.0, -2.0], 1), (91, [0.0, 0.0], 2)]
    assert mine(spark, rows) == plain_negatives(rows)
    assert mine(spark, []) == [] and mine(spark, [(0, [1.0], 1)]) == []


def test_negatives_of_scores_of_any_size(spark):
    """Sums past 2**53 and past 2**63 are told apart; only returned scores end at 64 bits."""
    rng = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=3) * 2.0 ** rng.choice([5, 20, 40])], k % 3) for k in range(90)]
    rows += [(100 + k, [1e30, float(k), 2e29 * k], k % 2) for k in range(12)]
    got = mine(spark, rows)
    assert got == plain_negatives(rows) and any(r[5] == (1 << 63) - 1 for r in got)
