"""A growing fetch log into a page store: each run stores the pages that arrived since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.urls import url_to_filename
from bindery.operators.fetch import DOWNLOADED, response_outcome
from bindery.streaming.names import first_comers, run_once, stream_settings

FETCHED = "seq long, url string, status int, content_type string, body string"


def store_fetched_pages(
    spark: SparkSession, log: str, store: str, checkpoint: str, start_url: str, max_files_per_batch: int = 100_000
) -> None:
    """Add the pages of Parquet files new below ``log`` (:data:`FETCHED`) to ``store`` and stop.

    A stored page is never replaced: of answers that share a file name the least ``seq`` of the batch that first has
    any is stored (then the least URL and content hash; no ``seq`` comes last). Where files arrive in the order of
    ``seq``, the cut into batches and runs does not show. Taken names are the stream's state, so a run reads neither
    the store nor older logs. A batch replaces its own folder, so a replayed one adds nothing. The store has no other
    writer; :func:`bindery.sources.sinks.read_page_store` reads it. The first run's ``spark.sql.shuffle.partitions``
    is the number of parts that the names are kept in.
    """
    answers = spark.readStream.schema(FETCHED).option("maxFilesPerTrigger", max_files_per_batch).parquet(log)
    pages = answers.filter((response_outcome() == DOWNLOADED) & F.col("url").isNotNull()).select(
        url_to_filename("url", F.lit(start_url)).alias("filename"),
        F.coalesce("seq", F.lit(2**63 - 1)).alias("seq"),
        "url",
        F.xxhash64("body").alias("hash"),
        F.col("body").alias("html"),
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.select("filename", "url", "html").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    with stream_settings(spark):
        run_once(first_comers(pages, "filename", ["seq", "url", "hash"]), checkpoint, write_batch)
