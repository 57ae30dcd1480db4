"""The numbered queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcover.llm import bpe, chat, html, langid, media, merkle, mixing, quality, simhash, substring, tokens, urls, whitening

#: Fixed rules of the URL query, and host names' labels whose pages make up its list of URLs.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
LISTED_LABELS = r"(^|\.)(casino-win|free-bets|cheap-pills|ads-track)\."


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Painted twice, once for the bytes and once for the corners, which is less work than to write the images.
    return media.near_copies(media.paint(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_conversations(chat.with_planted(_table(spark, sf_dir, "conversations"))))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "rule string, action string")
    listed = pages.where(urls.host(F.col("url")).rlike(LISTED_LABELS)).select(urls.canonical(F.col("url")).alias("entry"))
    return urls.judge(pages, rules, listed)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("source")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as long: a table so large that it passes 64 bits is an error here."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_source_mixing, op3_html_extraction, op4_bpe, op5_media_copies, op6_quality_rules, op7_chat_formatting, op8_url_filters, op9_substring_dedup, op10_language_id,
        op11_token_counts, op12_merkle_manifest, op13_embedding_whitening,
    )
}
