"""A corpus pipeline: five training-data operators over ``documents``, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.language_id import fit, keep_identified
from tessera.llm.mixing import mix
from tessera.llm.sentencepiece_codec import encode
from tessera.llm.simhash import keep_one
from tessera.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their labels teach; a null label becomes the language found.

    The model is learned from a bounded sample of the stage's own input. Null and
    empty texts, those without a letter, and those that no language makes likelier
    than chance go.
    """
    return keep_identified(docs, fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group with 0.8 or more of their five-word shingles in common.

    Documents without an id stay; rows that share an id stay or go together.
    """
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that start earlier too; n_chars follows the text. Null texts become empty; no document goes."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; a null source is a source of its own."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the text as its ids decode, with n_tokens and ids. Null texts become empty, with the end id alone."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "begins", "ends")]
    return encode(docs.select(*rest, "text"), model, decoded="text").select(*rest, F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Languages, fingerprints, the draw of copies and pieces can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
