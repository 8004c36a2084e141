"""The steps of a run, one function each: a result table, its step row, and what failed.

A result is written once; its counts and bytes are observed while it is written, so nothing is read a second time for
the report.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bindery.functions.markdown import STRIP_TAGS
from bindery.operators.combine import MAX_WORDS, SEPARATOR, bundle_pieces
from bindery.operators.convert import FAILED as NOT_CONVERTED
from bindery.operators.convert import OK, convert_files, failures
from bindery.operators.fetch import CACHED, DOWNLOADED, FAILED, fetch_urls, new_files
from bindery.operators.report import COMBINE_STEP, CONVERT_STEP, CRAWL_STEP, step_row
from bindery.operators.traverse import MAX_PAGES, traverse_site
from bindery.session import materialize, small_batches
from bindery.sources.files import is_zip_key, read_html_dir, read_html_files, read_zip
from bindery.sources.sinks import export_bundles, write_markdown


class Step(NamedTuple):
    """``result`` as written, ``row`` as :func:`step_result` gives it, ``failures(key, error)``."""

    result: DataFrame
    row: DataFrame
    failures: DataFrame


def observed(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` as written, and metrics taken while it was."""
    seen = Observation(label)
    written = materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), label)
    return written, seen.get


def crawl_step(
    fetch_log: DataFrame,
    start_url: str,
    output: str = "html",
    *,
    retry: DataFrame | None = None,
    url_prefix: str | None = None,
    max_pages: int = MAX_PAGES,
    cached: DataFrame | None = None,
) -> Step:
    """Traverse the site, or fetch exactly the ``retry(key[, ordinal])`` URLs of an earlier run's failures."""
    began = time.monotonic()
    if retry is None:
        crawl = traverse_site(fetch_log, start_url, url_prefix, max_pages, cached)
    else:
        nth = F.col("ordinal").cast("long") if "ordinal" in retry.columns else F.monotonically_increasing_id()
        wanted = materialize(retry.select(F.col("key").alias("url"), nth.alias("visit_seq")), "retry")
        crawl = fetch_urls(wanted, fetch_log, start_url, cached)
    crawl = materialize(crawl, "visits")
    # a kept page's bytes are those of the stored file, whichever URL stored it
    stored = new_files(crawl, fetch_log).select("filename", "html")
    if cached is not None:
        stored = stored.unionByName(cached.select("filename", "html"))
    sizes = stored.groupBy("filename").agg(F.max(F.octet_length("html")).cast("long").alias("n_bytes"))
    kept = F.when(F.col("outcome").isin(CACHED, DOWNLOADED), F.col("n_bytes"))
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    written, n = observed(
        crawl.join(sizes, "filename", "left").withColumn("n_bytes", kept),
        "crawl",
        file_count=is_(CACHED, DOWNLOADED),
        total_bytes=F.sum("n_bytes"),
        skipped_count=is_(CACHED),
        downloaded_count=is_(DOWNLOADED),
        failure_count=is_(FAILED),
    )
    row = step_row(fetch_log.sparkSession, CRAWL_STEP, output, time.monotonic() - began, **n)
    failed = written.filter(F.col("outcome") == FAILED).select(F.col("url").alias("key"), F.lit(FAILED).alias("error"))
    return Step(written, row, failed)


def convert_inputs(
    spark: SparkSession, html_dir: str | None, zip_paths: str | list[str] | None, retry: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Files to convert, and wanted keys that no longer exist.

    ``retry(key)`` goes before archives, archives before the folder. Retried keys that name an archive or one of its
    entries are looked for in ``zip_paths``, the others below ``html_dir``.
    """
    if retry is None:
        if zip_paths is not None:
            return read_zip(spark, zip_paths), None
        if html_dir is None:
            raise ValueError("nothing to convert: neither a folder nor archives")
        return read_html_dir(spark, html_dir).withColumn("error", F.lit(None).cast("string")), None
    wanted = materialize(retry.select("key").distinct(), "retry")
    parts, gone = [], []
    columns = ["key", "rel_path", "content", "is_text_file", "error"]
    if html_dir is not None:
        found, missing = read_html_files(read_html_dir(spark, html_dir), wanted.filter(~is_zip_key(F.col("key"))))
        parts.append(found.withColumn("error", F.lit(None).cast("string")).select(*columns))
        gone.append(missing.select("key"))
    else:
        gone.append(wanted.filter(~is_zip_key(F.col("key"))))
    of_archives = wanted.filter(is_zip_key(F.col("key")))
    if zip_paths is not None:
        entries = read_zip(spark, zip_paths, of_archives)
        parts.append(entries.select(*columns))
        here = entries.select("key").unionByName(entries.select(F.col("archive").alias("key")))
        gone.append(of_archives.join(here, "key", "left_anti"))
    else:
        gone.append(of_archives)
    if not parts:
        raise ValueError("nothing to convert: neither a folder nor archives")
    files, missing = parts[0], gone[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    for g in gone[1:]:
        missing = missing.unionByName(g)
    return files, missing


def convert_step(
    spark: SparkSession,
    html_dir: str | None = None,
    output: str = "md",
    *,
    zip_paths: str | list[str] | None = None,
    retry: DataFrame | None = None,
    strip_tags: Sequence[str] = STRIP_TAGS,
    table: str | None = None,
) -> Step:
    """Convert a retry list, archives or a folder, in this order; with ``table`` the Markdown is written there too."""
    files, missing = convert_inputs(spark, html_dir, zip_paths, retry)
    return convert_table(files, output, missing=missing, strip_tags=strip_tags, table=table)


def convert_table(
    files: DataFrame,
    output: str = "md",
    *,
    missing: DataFrame | None = None,
    strip_tags: Sequence[str] = STRIP_TAGS,
    table: str | None = None,
) -> Step:
    """Convert a table of files; ``missing(key)`` are wanted files that do not exist, and failed as such."""
    spark, began = files.sparkSession, time.monotonic()
    good = F.col("status") == OK
    with small_batches(spark):
        results, n = observed(
            convert_files(files, strip_tags),
            "markdown",
            file_count=F.count_if(good),
            total_bytes=F.sum(F.when(good, F.col("n_bytes"))),
            failure_count=F.count_if(F.col("status") == NOT_CONVERTED),
        )
    if table is not None:
        write_markdown(results, table)
    failed = failures(results)
    if missing is not None:
        missing = materialize(missing.distinct().select("key", F.lit("not found").alias("error")), "missing")
        n["failure_count"] += missing.count()
        failed = failed.unionByName(missing)
    return Step(results, step_row(spark, CONVERT_STEP, output, time.monotonic() - began, **n), failed)


def combine_step(
    sections: DataFrame,
    root: str,
    *,
    separator: str = SEPARATOR,
    max_words: int = MAX_WORDS,
    stem: str = "combined",
    corpora: DataFrame | None = None,
    **tuning,
) -> Step:
    """Combine sections into files below ``root``; the result lists them with their words, sections and bytes."""
    spark, began = sections.sparkSession, time.monotonic()
    bundles = bundle_pieces(sections, separator=separator, max_words=max_words, stem=stem, corpora=corpora, **tuning)
    export_bundles(bundles, root)
    sums = bundles.files.agg(F.count("*").alias("file_count"), F.sum("n_bytes").alias("total_bytes")).first()
    row = step_row(spark, COMBINE_STEP, f"{stem}.md", time.monotonic() - began, **sums.asDict())
    return Step(bundles.files, row, spark.createDataFrame([], "key string, error string"))
