"""Mixing, SentencePiece, language ID, quality and licenses on small tables, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import language_id, license_scan, mixing, quality
from tessera.llm.sentencepiece_codec import CharacterMap, Codec, decode, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = [None, "", " ", "\n", "a", "  two  blanks ", "▁under ▁▁ line", "tab\tand\r\nbreaks\n\n", "é漢字　ｘ́ K", "<s> </s> <unk> <0x41>", "\x00nul\x00", "😀 emoji 👩‍👩‍👧", "x" * 5000, "word " * 4000, "Released under the MIT License."]


def table(spark, texts, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


# --- mixing ---


def brute_targets(sizes, weights, most=3):
    free, total, target = set(sizes), sum(sizes.values()), {}
    while True:
        left = total - sum(target[s] for s in sizes if s not in free)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= most * sizes[s]}
        if not above:
            return target | share
        target |= {s: most * sizes[s] for s in above}
        free -= above
        if not free:
            return target


def test_targets_stop_and_share_the_excess(spark):
    sizes = {"a": 1000, "b": 10, "c": 20, "d": 400, "e": 5, "f": 300, None: 50, "empty": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weights = mixing.cyclic_weights(df)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    assert {r.source: r.weight for r in weights.collect()} == {s: k % 3 + 1 for k, s in enumerate(order)}
    got = {r.source: r for r in mixing.targets(df, weights).collect()}
    want = brute_targets({k: v for k, v in sizes.items()}, {s: k % 3 + 1 for k, s in enumerate(order)})
    for s, n in sizes.items():
        assert got[s].target == pytest.approx(want[s])
        assert got[s].copies + got[s].fraction == pytest.approx(min(3, want[s] / n) if n else 0)
        assert got[s].copies + (got[s].fraction > 0) <= 3


def test_mix_takes_what_the_plan_says(spark):
    rng = random.Random(3)
    rows = [(k, f"s{k % 4}" if k % 9 else None, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(30))) if k % 11 else None, "x") for k in range(800)]
    df = spark.createDataFrame([*rows, rows[5], (None, "s1", "no id", "x")], "doc_id long, source string, text string, size string")
    plan = mixing.plan(df).collect()
    assert len(plan) == 802 and {r.size for r in plan if r.id == 0} == {0}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    assert taken == Counter({i: n for i, n in Counter({k: sum(r.copies for r in plan if r.id == k) for k in {r.id for r in plan}}).items() if n})
    assert sorted(r.copies for r in mixing.plan(df).collect()) == sorted(r.copies for r in plan)
    by = {}
    for r in plan:
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.copies * r.size
    assert all(abs(got - want) < 0.01 * want for want, got in by.values())
    assert mixing.plan(df.limit(0)).count() == mixing.mix(df.limit(0)).count() == 0


def plain_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_small_sources_of_uneven_documents_meet_their_targets(spark):
    """50 documents each, the longest 50 times as long as the shortest: within 2 % of the target, sizes recounted, reruns equal."""
    rng = random.Random(11)
    rows = [(k, f"s{k % 20:02}", "w " * int(min(50, rng.paretovariate(0.9)) * 40) + "é\u00a0x\x1f") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.id: r for r in mixing.plan(df).collect()}
    assert {k: r.size for k, r in got.items()} == {k: plain_words(t) for k, _, t in rows}
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += plain_words(t)
    want = brute_targets(dict(sizes), {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    taken = Counter()
    for k, s, t in rows:
        taken[s] += got[k].copies * plain_words(t)
        assert got[k].target == pytest.approx(want[s]) and got[k].source_size == sizes[s]
        assert math.floor(want[s] / sizes[s]) <= got[k].copies <= math.floor(want[s] / sizes[s]) + 1 <= 4
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)
    assert {r.id: r.copies for r in mixing.plan(df.repartition(7)).collect()} == {k: r.copies for k, r in got.items()}


def test_the_further_copy_has_the_fraction_as_its_probability():
    """Over many seeds, short and long documents get it as often as each other; ties in size too."""
    sizes = np.array([5, 5, 5, 5, 900])
    for share in (0.3, 0.62):
        hits = np.zeros(5)
        rng = np.random.default_rng(7)
        for _ in range(4000):
            order = rng.permutation(4)
            n, took = mixing.draw_limit(sizes[4:], share * 900, rng.random())
            hits[4] += n
            assert took in (0, 900)
            n, took = mixing.draw_limit(sizes[:4][order], share * 20, rng.random())
            hits[order[:n]] += 1
        assert hits / 4000 == pytest.approx([share] * 5, abs=0.04)


def test_mix_with_clashing_names_long_texts_and_one_hot_source(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 5}", "w " * (60000 if k == 7 else 1 + k % 40)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = df.withColumns({c: F.lit("own") for c in ("of", "copies", "fraction", "for", "class_of", "upto", "copy", "drawn", "bin", "class", "size", "r", "__of", "__copies", "__times", "__k")})
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({r.id: r.copies for r in mixing.plan(df).collect()})
    assert {r.of for r in mixed.select("of").distinct().collect()} == {"own"}


# --- SentencePiece ---


def test_codec_equals_the_library_and_projects_to_bytes(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab é\n▁ 漢<>#0") for _ in range(rng.randrange(60))) for _ in range(300)]
    coded = encode(table(spark, texts, ids="clash", n="kept"), MODEL)
    rows = {r.doc_id: r for r in coded.collect()}
    back = {r.doc_id: r.decoded for r in decode(coded, MODEL).collect()}
    for k, t in enumerate(texts):
        raw, r = (t or "").encode(), rows[k]
        assert r.ids == sp.encode(t or "", add_eos=True) and r.n == "kept"
        assert back[k] == sp.decode(r.ids)
        assert r.begins[-1] == r.ends[-1] == len(raw)
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == raw
    for out in ("text", "clash"):
        both = encode(table(spark, texts, ids="clash", clash="old"), MODEL, decoded=out)
        assert {"ids", "begins", "ends", out} <= set(both.columns) and len(set(both.columns)) == len(both.columns)
        assert {r.doc_id: (r.ids, r[out]) for r in both.collect()} == {k: (rows[k].ids, back[k]) for k in rows}
    assert encode(table(spark, ["x"]).limit(0), MODEL).count() == 0


def darts(keys):
    """A compiled map of byte strings to replacements, as a double array built by brute force."""
    blob, values = b"", {}
    for k, v in keys.items():
        values[k] = len(blob)
        blob += v + b"\0"
    units, nodes = {0: 0}, [(b"", 0)]
    used = {0}
    for prefix, at in nodes:
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        offset = next(o for o in range(1, 4000) if all((at ^ o ^ c) not in used for c in labels + [0] * leaf) and (at ^ o) != at)
        units[at] |= offset << 10 | (0x100 if leaf else 0)
        if leaf:
            units[at ^ offset] = 0x80000000 | values[prefix]
            used.add(at ^ offset)
        for c in labels:
            units[at ^ offset ^ c] = c
            used.add(at ^ offset ^ c)
            nodes.append((prefix + bytes([c]), at ^ offset ^ c))
    flat = np.zeros(max(units) + 1, "<u4")
    for k, v in units.items():
        flat[k] = v
    return len(flat.tobytes()).to_bytes(4, "little") + flat.tobytes() + blob


def test_longest_prefix_of_the_character_map_keeps_alignment():
    keys = {"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "　".encode(): b" ", b"-": b""}
    found = CharacterMap(darts(keys))
    assert found.longest(b"zabcd", 1) == (3, b"YZ") and found.longest(b"abd", 0) == (2, b"X") and found.longest(b"a", 0) is None
    codec = Codec(MODEL)
    codec.map, codec.squeeze = found, True
    flat, begin, end = codec.normalise("　 abcé-　ab ﬁ ".encode())
    assert flat.decode() == "▁YZé▁X▁fi"
    source = "　 abcé-　ab ﬁ ".encode()
    spans = [source[a:b] for a, b in zip(begin, end, strict=True)]
    assert spans[3:5] == [b"abc", b"abc"] and spans[-2:] == ["ﬁ".encode()] * 2 and spans[10] == b"ab"


# --- language ID ---


def test_languages_mixtures_and_unknown(spark):
    words = {"en": "the of and to in that is was for with", "de": "der die und das ist nicht mit auf ein zu", "fr": "le la les des est une dans pour que avec"}
    rng = random.Random(2)
    make = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(k, make(lang, 60), lang) for k, lang in enumerate(rng.choice(sorted(words)) for _ in range(400))]
    df = spark.createDataFrame([*rows, (900, "unlabelled", None), (None, "das ist", "zz")], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ["de", "en", "fr"]
    tests = [make("en", 80), make("de", 300) + " " + make("fr", 100), None, "", "12 $$ \n", make("fr", 9000), "漢"]
    got = {r.doc_id: r for r in language_id.identify(table(spark, tests, lang_pred="clash"), model).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["en", "de", "und", "und", "und", "fr"] and got[6].lang_pred in model.languages
    assert got[1].lang_set == "de,fr" and 0.6 < got[1].lang_score < 0.9 and got[0].lang_set == "en"
    assert all(0 <= r.lang_score <= 1 for r in got.values()) and got[2].lang_score == 0
    held = language_id.identify(df.filter(language_id.held_out()), model).collect()
    assert len(held) > 50 and all(r.lang == r.lang_pred for r in held)
    # The last text is in a script that none of the languages has.
    assert [r.doc_id for r in language_id.keep_identified(table(spark, tests), model).orderBy("doc_id").collect()] == [0, 1, 5]
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(table(spark, tests), none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_other_languages_go_and_null_labels_are_filled(spark):
    """Texts of random letters, of another script, and of numbers go; those of the languages stay, with a label."""
    words = {"en": "the of and to in that is was for with", "de": "der die und das ist nicht mit auf ein zu"}
    rng = random.Random(5)
    make = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    noise = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [(k, make(("en", "de")[k % 2], rng.randrange(5, 90)), ("en", "de")[k % 2] if k % 10 else None) for k in range(300)]
    rows += [(1000 + k, noise("bcdfghjklmnpqrstvwxyz ", 300), "en") for k in range(10)] + [(1100 + k, noise("бвгдежзийклмн ", 200), None) for k in range(10)]
    rows += [(1200, "0123 4567 89", "en"), (1201, None, "de"), (1202, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_gain", F.lit("own"))
    model = language_id.fit(df.filter("doc_id < 1000"))
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id: (r.lang, r.lang_gain) for r in kept.collect()} == {k: (("en", "de")[k % 2], "own") for k in range(300)}
    assert language_id.keep_identified(df.limit(0), model).count() == 0
    none = language_id.fit(df.limit(0))
    assert {r.doc_id for r in language_id.keep_identified(df, none).collect()} == {r[0] for r in rows} - {1200, 1201, 1202}


def brute_mixture(model, text, penalty):
    """Segments, likelihoods and EM over every growing set of languages, one text and one number at a time."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in text.encode())
    per = []
    for low in range(0, len(raw), language_id.SEGMENT):
        total = [0.0] * len(model.languages)
        for k in range(low, min(low + language_id.SEGMENT, len(raw) - language_id.NGRAM + 1)):
            gram = raw[k : k + language_id.NGRAM]
            if gram.strip():
                bucket = (int.from_bytes(gram, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 16
                total = [t + float(v) for t, v in zip(total, model.table[bucket], strict=True)]
        per.append(total)

    def em(active):
        pi = {a: 1 / len(active) for a in active}
        top = [max(x) for x in per]
        odds = [{a: math.exp(x[a] - t) for a in active} for x, t in zip(per, top, strict=True)]
        for _ in range(language_id.ROUNDS):
            got = {a: 0.0 for a in active}
            for o in odds:
                z = sum(o[a] * pi[a] for a in active) + 1e-30
                for a in active:
                    got[a] += o[a] * pi[a] / z
            pi = {a: got[a] / len(per) for a in active}
        return pi, sum(math.log(sum(o[a] * pi[a] for a in active) + 1e-30) + t for o, t in zip(odds, top, strict=True))

    alone = [sum(x[a] for x in per) for a in range(len(model.languages))]
    pi, have = {max(range(len(alone)), key=alone.__getitem__): 1.0}, max(alone)
    while len(pi) < len(model.languages):
        tries = [(em([*pi, a]), a) for a in range(len(model.languages)) if a not in pi]
        (best, value), _ = max(tries, key=lambda t: (t[0][1], -t[1]))
        if value - have <= penalty + 0.5 * math.log(len(per)):
            break
        pi, have = best, value
    return pi


def test_mixtures_equal_a_plain_expectation_maximisation(spark):
    words = {"en": "the of and to in that is was for with", "de": "der die und das ist nicht mit auf ein zu", "fr": "le la les des est une dans pour que avec"}
    rng = random.Random(6)
    make = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    df = spark.createDataFrame([(k, make(lang, 40), lang) for k, lang in enumerate(sorted(words) * 60)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    texts = [" ".join(make(lang, rng.randrange(1, 60)) for lang in rng.sample(sorted(words), rng.choice((1, 1, 2, 3)))) for _ in range(60)] + ["x", "Zz 12 é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    share, _, _ = model.mixtures(data, at, 3.0)
    sizes = Counter()
    for k, t in enumerate(texts):
        want = brute_mixture(model, t, 3.0)
        sizes[len(want)] += 1
        assert share[k] == pytest.approx([want.get(a, 0.0) for a in range(3)], abs=1e-3), t
    assert sizes[1] > 10 and sizes[2] > 5 and sizes[3] > 3


def test_em_finds_the_proportions():
    odds = np.array([[1.0, 0.01]] * 30 + [[0.02, 1.0]] * 10)
    pi, _ = language_id._em(odds, np.array([0, 40]), np.array([40]), np.array([[True, True]]))
    assert pi[0] == pytest.approx([0.75, 0.25], abs=0.02)


# --- quality ---


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {p for k, g in enumerate(tri) if tri.count(g) > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_figures_and_cascade(spark):
    rng = random.Random(4)
    texts = HARD + ["\n".join(" ".join(rng.choice(("a", "bb", "c#", "<d>", "é")) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts = [t for t in texts if t is None or len(t) < 6000]
    show = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = table(spark, texts, kept="clash")
    rules = quality.order(df, quality.MORE_RULES)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.MORE_RULES)
    for given in (rules, rules[::-1]):
        got = {r.doc_id: r for r in quality.cascade(df, given, show=show, base=quality.BASE_RULES).collect()}
        for k, t in enumerate(texts):
            want = brute_quality(t)
            assert tuple(got[k][c] for c in show) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            f = quality.Features(t)
            assert got[k].base_failed == failed and got[k].kept == (not failed and not any(r.fails(f) for r in quality.MORE_RULES))
    assert quality.cascade(df.limit(0), quality.order(df.limit(0), quality.MORE_RULES)).count() == 0


def test_nearly_free_rules_come_first(spark):
    """Two rules reject the same rows, one by figures that are shown anyway; rows that a base rule rejects count for neither."""
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(100)) for _ in range(300)) for _ in range(80)] + ["# " * 20] * 200
    show = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rules = tuple(r for r in quality.MORE_RULES if r.name in ("bare_words", "short_words", "symbols"))
    found = quality.order(table(spark, texts), rules, show=show, base=quality.BASE_RULES)
    assert [r.name for r in found] == ["short_words", "bare_words", "symbols"]


def brute_more(text):
    """Whether a rule beyond the base rejects, from regular expressions over the whole text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    pairs = Counter(zip(w, w[1:], strict=False))
    return (
        10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or not 5 * len(w) <= 2 * sum(map(len, w)) <= 30 * len(w)
        or 5 * sum(not re.search(r"[A-Za-z]|[^\x00-\x7F]", x) for x in w) > len(w) or 10 * sum(bool(re.match(r"[\x20\x09-\x0D]*[*•-]", x)) for x in lines) > 9 * len(lines)
        or 10 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines) > 3 * len(lines) or 5 * max((n * len(a + b) for (a, b), n in pairs.items()), default=0) > sum(map(len, w))
    )


def test_each_further_rule_rejects_and_clean_texts_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéfgh") for _ in range(rng.randrange(3, 9)))
    line = lambda: " ".join(word() for _ in range(9))
    clean = [[line() for _ in range(12)] for _ in range(20)]
    bad = [["- " + x for x in clean[0]], [" • " + x for x in clean[1]], [x + ("..." if k % 2 else "… ") for k, x in enumerate(clean[2])], [x + " 12 3.4 -- 99" for x in clean[3]], [x + " same-long-one second-long-one" + str(rng.random())[2:4] * (k % 2) for k, x in enumerate(clean[4])], clean[5][:1] * 6 + clean[5]]
    texts = ["\n".join(x) for x in clean + bad] + ["\n".join(clean[0] * 400), clean[6][0] + " x" * 90000]
    got = {r.doc_id: r for r in quality.cascade(table(spark, texts), quality.MORE_RULES).collect()}
    assert [got[k].kept for k in range(len(texts))] == [not brute_more(t) for t in texts]
    assert all(got[k].kept for k in range(20)) and not any(got[k].kept for k in range(20, 24))


def test_rules_behind_a_failure_cost_nothing(spark):
    """Each statistic is counted in each text that asks for it; with no base and nothing to show, the first failure is all there is."""
    counts = Counter()

    class Counted(quality.Features):
        def __getattribute__(self, name):
            if name.startswith(("n_", "top_")):
                counts[name] += 1
            return super().__getattribute__(name)

    rules = sorted(quality.MORE_RULES, key=lambda r: r.name != "symbols")
    for text in ("### " * 60, "word and other things to read " * 3):
        f = Counted(text)
        any(r.fails(f) for r in rules)
    assert counts["n_symbols"] == 2 and counts["top_pair_chars"] == counts["n_bare_words"] == 1


def test_repeated_rows_ties_and_the_sample(spark):
    df = spark.createDataFrame([(1, "same words " * 40, "x")] * 300 + [(2, None, None)], "doc_id long, text string, place string")
    rules = quality.order(df, quality.MORE_RULES, sample=10)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.MORE_RULES)
    got = quality.cascade(df, rules).groupBy("doc_id", "place", "kept").count().collect()
    assert sorted((r.doc_id, r.kept, r["count"]) for r in got) == [(1, False, 300), (2, True, 1)]


def test_cascade_stops_at_the_first_failure(spark):
    def boom(_):
        raise AssertionError("ran after a failure")

    rules = [quality.Rule("no", lambda f: True), quality.Rule("boom", boom)]
    assert {r.kept for r in quality.cascade(table(spark, ["a", None]), rules).collect()} == {False}


# --- licenses ---


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    low = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    labels = {label for _, label in places}
    stride = license_scan.stride_of()
    for b in range(max(1, len(low))):
        block = set(low[b : b + 2 * stride])
        for label, template in license_scan.TEMPLATES:
            t = set(template.split())
            if len(t & block) >= license_scan.THRESHOLD * len(t) - 1e-9:
                labels.add(label)
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_long_templates_score_in_full_at_any_offset(spark):
    """A template of 90 words is held whole by a block wherever it stands, also at a threshold of 1, in short and in very long texts."""
    words = [f"t{k}" for k in range(90)]
    texts = [" ".join(["x"] * n + words + ["y"] * 50) for n in (0, 1, 31, 44, 89, 90, 133, 50000)] + [" ".join(["x"] * 40 + words[:89]), " ".join(words[:60])]
    got = {r.doc_id: r for r in license_scan.scan(table(spark, texts), templates=(("long", " ".join(words)),), threshold=1.0).collect()}
    assert [(got[k].labels, got[k].score) for k in range(10)] == [("long", 1.0)] * 8 + [("", 0.0)] * 2


def test_a_label_does_not_depend_on_the_start(spark):
    """The 17 distinct words of a notice, spread over as many words as a block has, at every offset."""
    label, notice = license_scan.TEMPLATES[2]
    w, size = notice.split(), 2 * license_scan.stride_of()
    spread = [f"n{k}" for k in range(size)]
    for k, word in enumerate(w):
        spread[round(k * (size - 1) / (len(w) - 1))] = word
    texts = [" ".join(["x"] * offset + spread + ["y"] * 40) for offset in range(2 * size)]
    assert {r.labels for r in license_scan.scan(table(spark, texts)).collect()} == {label}
    wider = [" ".join(["x"] * offset + [z for word in w for z in (word, *["n"] * 9)]) for offset in range(0, 2 * size, 5)]
    assert {r.labels for r in license_scan.scan(table(spark, wider)).collect()} == {""}


def test_license_columns_of_any_name_stay(spark):
    clash = ("base_words", "all_words", "some_words", "found", "place0", "share0", "__base", "__words", "__p0", "__s1", "__blocks")
    df = table(spark, ["MIT License here", None, "mit license " * 3, "MIT License here"], **{c: "own" for c in clash})
    rows = license_scan.scan(df).collect()
    assert sorted((r.doc_id, r.n_base) for r in rows) == [(0, 1), (1, 0), (2, 3), (3, 1)]
    assert all(r[c] == "own" for r in rows for c in clash)


def test_licenses_equal_a_scan_of_all_blocks(spark):
    rng = random.Random(6)
    noise = "the of and license software under terms mit cc by free this gnu x1 é".split()
    texts = [*HARD, "MIT-license, mit  license; CC BY cc.by", "GNU General\nPublic License apache license apache licenses", "mit licenseé mit lıcense", "By cc"]
    for _ in range(120):
        words = [rng.choice(noise) for _ in range(rng.randrange(120))]
        _, template = rng.choice(license_scan.TEMPLATES)
        part = [t for t in template.split() if rng.random() < 0.93]
        at = rng.randrange(len(words) + 1)
        texts.append(rng.choice((" ", ", ", "\n")).join(words[:at] + part + words[at:]))
    df = table(spark, texts, labels="clash", other=1)
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_licenses(t), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and r.other == 1
    assert license_scan.scan(df.limit(0)).count() == 0

