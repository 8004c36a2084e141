"""Two-pass external shuffle into shards.

First pass: a seeded hash scatters records uniformly over buckets sized for a task's memory. Second pass: each
bucket is Fisher-Yates shuffled by itself and written. The shuffled buckets, one after the other, are a random
order of all records; shards are equal stretches of it, so their row counts are at most one apart.

Defined cases: null and empty texts are records like others; records that agree in both doc_id and text share a bucket
(copies under other ids do not); an empty table gives no rows; other columns are carried through; ``bucket``,
``shard`` and ``slot`` replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import running_sum
from bindery.session import materialize

SEED = 29
BUCKET_BYTES = 16 << 20


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shuffle_shards(
    docs: DataFrame, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All columns of ``docs`` with ``bucket``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    named = docs.drop("bucket", "shard", "slot")
    # columns get plain names on the way, so that the caller's may be called anything
    plain = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(named.columns)]
    docs = named.toDF(*plain)
    total = docs.agg(F.sum(record_bytes(F.col("text")))).first()[0] or 0
    n_buckets = max(1, -(-int(total) // bucket_bytes))
    salt = F.xxhash64(F.lit(seed), "doc_id", "text")
    scattered = docs.withColumn("_bucket", F.pmod(salt, F.lit(n_buckets)))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", _bucket long, _pos long"

    def fisher_yates(key: tuple, bucket: pa.Table) -> pa.Table:
        # a fixed order first: rows arrive as tasks end
        bucket = bucket.sort_by([("_order", "ascending"), ("doc_id", "ascending")]).drop_columns(["_order"])
        turn = np.random.default_rng([seed, key[0].as_py()]).permutation(bucket.num_rows)
        positions = pa.array(np.arange(bucket.num_rows, dtype=np.int64))
        return bucket.take(pa.array(turn)).append_column("_pos", positions)

    dealt = scattered.withColumn("_order", F.xxhash64("doc_id", "text", F.lit(seed + 1)))
    written = materialize(dealt.groupBy("_bucket").applyInArrow(fisher_yates, schema), "buckets")
    counts = written.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    offsets = running_sum(counts, "_all", [F.col("_bucket")], "_n", "bucket-offsets")
    offsets = offsets.select("_bucket", F.col("before").alias("_before"), F.col("total").alias("_total"))
    # exact in integers: shard s begins at ceil(s * rows / shards)
    shard = F.expr(f"(_before + _pos) * {n_shards}L div _total")
    first = F.expr(f"(_shard * _total + {n_shards - 1}L) div {n_shards}L")
    placed = written.join(offsets, "_bucket").withColumn("_shard", shard)
    placed = placed.withColumn("slot", F.col("_before") + F.col("_pos") - first)
    placed = placed.withColumn("shard", F.col("_shard").cast("int")).withColumn("bucket", F.col("_bucket"))
    return placed.select(*plain, "slot", "shard", "bucket").toDF(*named.columns, "slot", "shard", "bucket")


def write_shards(shards: DataFrame, path: str) -> None:
    """One folder per shard; rows keep ``slot`` as their order within it."""
    shards.write.mode("overwrite").partitionBy("shard").parquet(path)
