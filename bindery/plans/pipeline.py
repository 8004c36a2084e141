"""The whole run: traverse, convert, combine, report — and the retry form of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.markdown import STRIP_TAGS
from bindery.operators.combine import MAX_WORDS, SEPARATOR, build_sections, combine
from bindery.operators.convert import convert_pages
from bindery.operators.fetch import CACHED, DOWNLOADED, new_files
from bindery.operators.report import COMBINE_STEP, pipeline_report, report_lines, step_row
from bindery.operators.report_document import write_report_document
from bindery.operators.traverse import MAX_PAGES
from bindery.plans.steps import convert_table, crawl_step, observed
from bindery.session import materialize


class Run(NamedTuple):
    crawl: DataFrame
    pages: DataFrame
    markdown: DataFrame
    bundles: DataFrame
    crawl_failures: DataFrame
    convert_failures: DataFrame
    #: The report as one row, for as long as it fits one; nothing is computed unless it is read.
    report: DataFrame
    #: The same report as rows of any number, see :func:`report_lines`.
    lines: DataFrame
    #: Writes the report to the file of the path given, as :func:`write_report_document` does.
    write_report: Callable[[str], None]


def run_pipeline(
    fetch_log: DataFrame,
    start_url: str,
    *,
    url_prefix: str | None = None,
    max_pages: int = MAX_PAGES,
    cached: DataFrame | None = None,
    retry_crawl: DataFrame | None = None,
    retry_convert: DataFrame | None = None,
    markdown: DataFrame | None = None,
    separator: str = SEPARATOR,
    add_source_header: bool = True,
    max_words: int = MAX_WORDS,
    strip_tags: Sequence[str] = STRIP_TAGS,
    corpus: str = "combined",
    command: str = "",
) -> Run:
    """Crawl, convert and combine one site.

    ``cached`` are stored pages ``(filename, url, html)``. With ``retry_crawl`` and
    ``retry_convert`` (tables of an earlier run's failures, ``key`` and optionally
    ``ordinal``) only those are fetched and converted, and ``markdown`` of the earlier run is combined with the result.
    """
    spark = fetch_log.sparkSession
    began = time.monotonic()
    crawled = crawl_step(
        fetch_log, start_url, retry=retry_crawl, url_prefix=url_prefix, max_pages=max_pages, cached=cached
    )
    crawl = crawled.result
    pages = new_files(crawl, fetch_log).select("filename", "url", "html")
    if cached is not None:
        pages = pages.unionByName(cached.select("filename", "url", "html"))
    pages = materialize(pages.withColumn("n_bytes", F.octet_length("html").cast("long")), "pages")

    targets, missing = pages, None
    if retry_convert is not None:
        kept = crawl.filter(F.col("outcome").isin(CACHED, DOWNLOADED))
        asked = retry_convert.select("key").unionByName(kept.select(F.col("filename").alias("key"))).distinct()
        targets = pages.join(asked.select(F.col("key").alias("filename")), "filename", "left_semi")
        missing = asked.join(pages.select(F.col("filename").alias("key")), "key", "left_anti")
    files = targets.select(
        F.col("filename").alias("key"),
        F.col("filename").alias("rel_path"),
        F.encode("html", "UTF-8").alias("content"),
        F.lit(True).alias("is_text_file"),
    )
    converted = convert_table(files, missing=missing, strip_tags=strip_tags)
    failed = converted.failures
    good = converted.result.filter(F.col("status") == "ok").select("md_path", "markdown", "n_bytes")

    started = time.monotonic()
    texts = good.select("md_path", "markdown")
    if markdown is not None:
        texts = texts.unionByName(markdown.select("md_path", "markdown").join(good.select("md_path"), "md_path", "left_anti"))
    sections = build_sections(texts, F.lit(corpus), F.col("md_path"), F.col("markdown"), add_source_header)
    corpora = spark.range(1).select(F.lit(corpus).alias("corpus"))
    bundles, n = observed(
        combine(sections, separator=separator, max_words=max_words, stem=corpus, corpora=corpora),
        "bundles",
        file_count=F.count("*"),
        total_bytes=F.sum(F.octet_length("text")),
    )
    joined = step_row(spark, COMBINE_STEP, f"{corpus}.md", time.monotonic() - started, **n)

    steps = [crawled.row, converted.row, joined]
    crawl_failed = crawled.failures.select("key")
    seconds = time.monotonic() - began
    words = bundles.select(F.col("file_name").alias("key"), "n_words")
    listed = {"crawl": crawl_failed, "convert": failed.select("key")}
    lines = report_lines(steps, {COMBINE_STEP: words}, listed)
    mapped = words.agg(F.map_from_entries(F.collect_list(F.struct("key", "n_words"))).alias("output_word_counts"))
    whole = [crawled.row, converted.row, joined.drop("output_word_counts").join(mapped)]
    report = pipeline_report(whole, seconds, crawl_failed, failed.select("key"), command)
    document = partial(
        write_report_document, steps=steps, words={COMBINE_STEP: words}, failures=listed,
        total_elapsed_seconds=seconds, command=command,
    )
    return Run(crawl, pages, texts, bundles, crawl_failed, failed, report, lines, document)


def markdown_chunks(
    pages: DataFrame, max_words: int = MAX_WORDS, separator: str = SEPARATOR, corpus: str = "pages"
) -> DataFrame:
    """Pages ``(page_id, html)`` straight to bundles, ordered by their zero-padded name."""
    done = convert_pages(pages, "page_id", "html").filter("status = 'ok'").select("key", "markdown")
    done = materialize(done, "markdown")
    name = F.format_string("%012d.md", "key")
    return combine(
        build_sections(done, F.lit(corpus), name, F.col("markdown")),
        separator=separator,
        max_words=max_words,
        stem=corpus,
    )
