"""Page conversion with row-level failure status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import text as t
from bindery.functions.markdown import STRIP_CLASSES, STRIP_TAGS, html_to_markdown
from bindery.session import materialize

OK, FAILED, DUPLICATE = "ok", "failed", "duplicate"
SAME_NAME = "another file has the same Markdown name"


def convert_pages(
    pages: DataFrame,
    key: Column | str = "url",
    html: Column | str = "html",
    strip_tags: Sequence[str] = STRIP_TAGS,
    strip_classes: Sequence[str] = STRIP_CLASSES,
) -> DataFrame:
    """``key, markdown, n_words, n_bytes, region, status, error`` — a narrow, shuffle-free step."""
    key = F.col(key) if isinstance(key, str) else key
    html = F.col(html) if isinstance(html, str) else html
    out = pages.select(key.alias("key"), html_to_markdown(html, strip_tags, strip_classes).alias("c"))
    out = out.select("key", t.normalize_whitespace("c.markdown").alias("markdown"), "c.region", "c.status", "c.error")
    return out.select(
        "key",
        "markdown",
        t.word_count("markdown").alias("n_words"),
        F.octet_length("markdown").cast("long").alias("n_bytes"),
        "region",
        "status",
        "error",
    )


def convert_files(
    files: DataFrame,
    strip_tags: Sequence[str] = STRIP_TAGS,
    strip_classes: Sequence[str] = STRIP_CLASSES,
) -> DataFrame:
    """Convert a scanned file table ``key, rel_path, content, is_text_file``.

    Adds ``md_path``. Where ``x.html`` and ``x.htm`` share a Markdown name the first path
    wins and the other row is reported as a duplicate, unconverted. Where the scan has an
    ``error`` column, its errors stay with their rows.

    Duplicates are found from names alone and written out first. They are few, and their
    measured size lets the join with the contents broadcast instead of moving contents.
    """
    names = files.select("key", "rel_path", t.markdown_path("rel_path").alias("md_path"))
    first = names.groupBy("md_path").agg(F.min_by("key", t.path_order("rel_path")).alias("owner"), F.count("*").alias("n"))
    lost = names.join(first.filter("n > 1"), "md_path").filter("key <> owner").select("key")
    lost = materialize(lost, "duplicates").withColumn("lost", F.lit(True))
    marked = files.join(lost, "key", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    return convert_marked(marked, strip_tags, strip_classes)


def convert_marked(
    marked: DataFrame,
    strip_tags: Sequence[str] = STRIP_TAGS,
    strip_classes: Sequence[str] = STRIP_CLASSES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`convert_files` of files whose duplicates are known (``lost``); columns of ``carry`` follow the others."""
    text = t.decode_utf8(F.when(~F.col("lost"), F.col("content")))
    text = F.when(F.col("is_text_file"), t.universal_newlines(text)).otherwise(text)
    scan_error = F.col("error") if "error" in marked.columns else F.lit(None).cast("string")
    identity = F.struct("key", t.markdown_path("rel_path").alias("md_path"), "lost", scan_error.alias("error"), *carry)
    done = convert_pages(marked.select(identity.alias("id"), text.alias("html")), "id", "html", strip_tags, strip_classes)
    return done.select(
        "key.key",
        "key.md_path",
        "markdown",
        "n_words",
        "n_bytes",
        "region",
        F.when(F.col("key.lost"), F.lit(DUPLICATE)).otherwise(F.col("status")).alias("status"),
        F.when(F.col("key.lost"), F.lit(SAME_NAME)).otherwise(F.coalesce("key.error", "error")).alias("error"),
        *[f"key.{c}" for c in carry],
    )


def converted(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == OK)


def failures(results: DataFrame) -> DataFrame:
    """Keys to retry. A duplicate is reported, but retrying it would not help."""
    return results.filter(F.col("status") == FAILED).select("key", "error")
