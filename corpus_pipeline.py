"""Corpus preparation: quality, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The models are learned from the labelled training rows among the documents that reach the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import mixing, near_dedup, packing, quality, toxicity
from latticework.llm.common import materialize, table


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with names of their own for all columns that no stage reads, and the way back: the columns of docs alone."""
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"extra{i}" for i, c in enumerate(names)])
    return plain, lambda df: df.select(*plain.columns).toDF(*names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the level; with no labelled example of either class, all.

    Null and empty texts are scored like a text without any feature; rows that repeat a text share its fate, null ids
    are scored like others. Nothing comes of an empty table. Columns are those of docs, whatever their names.
    """
    plain, back = apart(docs)
    model = quality.fit(plain, table(spark, sf_dir, "labels"))
    return back(quality.score(plain, model).where("quality_kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the level.

    Null and empty texts, and those without a term of any example, have the share of toxic documents among the labelled
    ones as their score; rows that repeat a text share its fate, null ids are scored like others. Nothing comes of an
    empty table. Columns are those of docs, whatever their names.
    """
    plain, back = apart(docs)
    model = toxicity.fit(plain, table(spark, sf_dir, "labels"))
    return back(toxicity.score(plain, model).where(F.col("toxic_score") < toxicity.LEVEL))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (similarity 0.8): that of the smallest id, one without id last.

    Every row enters the classes under a key of its own, so unrelated texts under one id all stay, and rows without
    an id are classed like others. Rows without words (null, empty, white space) are alone: repeated ones (doc_id, text)
    stay once. Nothing comes of an empty table. Columns are those of docs, whatever their names.
    """
    plain, back = apart(docs)
    keyed = materialize(plain.withColumn("_key", F.monotonically_increasing_id()))
    classes = near_dedup.near_duplicates(keyed, id_col="_key").select("_key", "n_shingles", "component_id")
    # without words the class is the row itself: such rows are grouped by their text instead
    blank_text = F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.col("text"))
    known = classes.join(keyed.select("_key", "doc_id", F.xxhash64("text").alias("_hash"), blank_text.alias("_blank")), "_key")
    worded = known.where("n_shingles > 0").groupBy("component_id").agg(F.min_by("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_key")).alias("_key"))
    blank = known.where("n_shingles = 0").groupBy("doc_id", "_blank").agg(F.min("_key").alias("_key"))
    kept = worded.select("_key").unionByName(blank.select("_key"))
    return back(keyed.join(kept, "_key", "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Texts without words (null, empty, white space) weigh nothing and are taken at the rounded rate of their source, not
    at all where the whole source has no word. Null sources are a source of their own; repeated rows share a decision,
    null ids are taken like others. Nothing comes of an empty table. Columns are those of docs, whatever their names.
    """
    plain, back = apart(docs)
    mixed = mixing.mix(plain)
    return back(mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their ids and the ids' checksum.

    Null and empty texts are one end mark; repeated rows are packed each, null ids like others. Nothing comes of an empty
    table. Extra columns, whatever their names, are left behind.
    """
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned models, balanced sampling and tokenization have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
