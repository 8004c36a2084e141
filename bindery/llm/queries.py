"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import (
    langid,
    licenses,
    mixing,
    negatives,
    packing,
    pivots,
    quality,
    sharding,
    simhash,
    suffixes,
    urlfilter,
    vectors,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    mixed = mixing.mixture(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a packed sequence."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    languages, model = langid.train(docs)
    rows = docs.withColumn("held_out", langid.held_out())
    predicted = langid.predict(rows, languages, model, ["doc_id", "held_out"])
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier document repeats."""
    return suffixes.repeats(_table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document after a full shuffle into 24 shards."""
    shards = sharding.shuffle_shards(_table(spark, sf_dir, "documents"), 24)
    return shards.select(
        "doc_id",
        sharding.record_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return simhash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and phrase places of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles and near-duplicate component of every document."""
    found = pivots.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened, one row per component."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.withColumn("held_out", quality.held_out()), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_QUERIES = (
    op1_mix_sources,
    op2_pack_sequences,
    op3_language_id,
    op4_suffix_dedup,
    op5_shard,
    op6_simhash,
    op7_vector_near_dedup,
    op8_license_scan,
    op9_simhash_near_dedup,
    op10_url_filter,
    op11_whitening,
    op12_quality_classifier,
    op13_hard_negatives,
)
