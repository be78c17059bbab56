"""The stages of the corpus pipeline on a small table, each against what it should do to its own input."""

import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.common import materialise

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rng = random.Random(1)
    words = {"en": "the of and to in that is was for with this".split(), "de": "der die und das ist nicht mit auf ein zu im".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(n))
    passage = text("en", 60)
    rows = [(k, text(lang, rng.randrange(20, 200)), lang, f"s{k % 3}") for k in range(120) for lang in [("en", "de")[k % 2]]]
    rows += [(200 + k, rows[k][1], "en", "s0") for k in range(10)] + [(300 + k, text("en", 50) + " " + passage, "en", "s1") for k in range(4)]
    rows += [(400, None, None, None), (401, "", "en", "s2"), (402, "12 34 !!", "en", "s2")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS), passage


def test_stages(spark, tmp_path):
    docs, passage = documents(spark)
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialise(stage(spark, frames[-1], "")))
    for df in frames[1:-1]:
        assert df.columns == docs.columns
    ids = [sorted(r.doc_id for r in df.collect()) for df in frames]
    assert set(ids[0]) - set(ids[1]) == {400, 401, 402}
    assert set(ids[1]) - set(ids[2]) == set(range(200, 210))
    assert ids[3] == ids[2]
    before, after = ({r.doc_id: r for r in df.collect()} for df in frames[2:4])
    assert passage in after[300].text and all(passage not in after[k].text for k in (301, 302, 303))
    assert all(after[k].text == before[k].text for k in range(120)) and all(r.n_chars == len(r.text) for r in after.values())
    assert set(ids[4]) <= set(ids[3]) and max(map(ids[4].count, ids[4])) <= 3
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in frames[-1].collect():
        assert r.ids == sp.encode(after[r.doc_id].text, add_eos=True) and r.n_tokens == len(r.ids) and r.text == sp.decode(r.ids)


def test_run_and_empty_table(spark, tmp_path):
    docs, _ = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first, again = (corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "text").collect() for _ in range(2))
    assert first and sorted(map(tuple, first)) == sorted(map(tuple, again))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_each_operator_has_its_query():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
