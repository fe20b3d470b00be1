"""Corpus pipeline: documents -> toxicity filter -> exact dedup -> SimHash near-dedup -> source mix -> BPE.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomen.llm._spark import col, materialize, read
from nomen.llm.bpe import bpe_encode
from nomen.llm.exact_dedup import exact_dedup
from nomen.llm.mixing import mixed_structs
from nomen.llm.queries import THRESHOLD, bpe_digest
from nomen.llm.simhash import simhash_groups
from nomen.llm.toxicity import toxicity_scores

#: No SQL can express the toxicity model, SimHash or BPE: tested against brute force instead.
ORACLE_SQL = None


def _others(docs: DataFrame) -> list:
    return [col(c) for c in docs.columns if c != "text"]


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``text`` and the struct ``row`` of the others."""
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject (score under 0.7)."""
    out = toxicity_scores(docs, read(spark, sf_dir, "labels"), carry=_others(docs))
    return _columns(out.where(F.col("score") < THRESHOLD), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup(docs, carry=[col(c) for c in docs.columns]).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (3-word shingles, at most 3 bits)."""
    return _columns(simhash_groups(docs, shingle=3, max_bits=3, carry=_others(docs)).where("kept"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is drawn, the last of a source cut to its first words, shards
    shuffled locally."""
    out = mixed_structs(docs).repartition("shard").sortWithinPartitions("shard", "place")
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return _columns(out, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row of the mix."""
    import public_tokenizers
    return bpe_digest(bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=[F.col("doc_id")]))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
