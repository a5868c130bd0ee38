"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, fill_middle, language_id, mixing, near_dedup, oracles, packing, preferences, quality, search, toxicity, url_filter, whitening
from .common import table

#: Rules of the URL query: verdict, host, path.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
#: Site names whose pages make up the URL query's list.
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another conversation's last reply; spans as text."""
    pairs = preferences.with_partner_replies(table(spark, sf_dir, "conversations"))
    out = preferences.format_preferences(pairs)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("conv_id", "prompt_turns", "prompt", "chosen_text", "rejected_text", said("chosen_spans").alias("chosen_spans"), said("rejected_spans").alias("rejected_spans"))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for the whole text of every document whose id is divisible by 20, among all documents."""
    docs = table(spark, sf_dir, "documents")
    return search.bm25_top_k(docs, docs.where("doc_id % 20 = 0"), k=10)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85 (see near_duplicates)."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the list holds the urls of the sites in LISTED_SITES."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sites = F.array(*map(F.lit, LISTED_SITES))
    listed = url_filter.with_parts(pages.select("url"), "url").where(F.arrays_overlap(F.split("host", "\\."), sites)).select("url")
    return url_filter.url_verdicts(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its nearest labelled examples."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    out = mixing.mix_decisions(table(spark, sf_dir, "documents")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; pieces with a checksum of their ids."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by Bradley-Terry ranking."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.9."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words."""
    return language_id.languages(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix; digests of the outputs and of the texts restored from them."""
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's BPE ids and the text decoded from them, as digests."""
    vocabulary = byte_bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    coded = docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "ids")
    return byte_bpe.decode(coded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four whitened coordinates of every embedding. Deviations past 64 bits are null (see whiten for their digits)."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    each = out.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_chat_preferences, op2_bm25_search, op3_near_dedup, op4_url_filter, op5_toxicity, op6_mix_sources, op7_pack_hilbert, op8_quality, op9_embedding_dedup, op10_language_id, op11_fill_middle, op12_byte_bpe, op13_whitening)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries it can express; learned, sampled, tokenized and ranked results are tested otherwise."""
    return {
        "op1_chat_preferences": oracles.OP1,
        "op3_near_dedup": oracles.OP3,
        "op4_url_filter": oracles.op4(URL_RULES, LISTED_SITES),
        "op9_embedding_dedup": oracles.OP9,
        "op11_fill_middle": oracles.OP11,
    }
