"""Fetch outcomes: cache hits, downloads, failures and non-HTML answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.html import anchor_hrefs
from bindery.functions.urls import url_to_filename

CACHED, DOWNLOADED, FAILED, NON_HTML = "cached", "downloaded", "failed", "non_html"


def response_outcome(status: Column | str = "status", content_type: Column | str = "content_type") -> Column:
    """Outcome of a fresh request; anything but 2xx (or no answer) is a failure."""
    status = F.col(status) if isinstance(status, str) else status
    kind = F.col(content_type) if isinstance(content_type, str) else content_type
    return (
        F.when(~F.coalesce(status.between(200, 299), F.lit(False)), F.lit(FAILED))
        .when(F.contains(F.coalesce(kind, F.lit("")), F.lit("text/html")), F.lit(DOWNLOADED))
        .otherwise(F.lit(NON_HTML))
    )


def site_table(fetch_log: DataFrame) -> DataFrame:
    """``url, response, hrefs``: all that traversal needs, without the page bodies.

    Of several answers for a URL one counts: a page before other content before a failure, then the page of the
    least content hash. :func:`new_files` stores the same page.
    """
    response = response_outcome()
    hrefs = F.when(response == DOWNLOADED, anchor_hrefs("body"))
    answer = F.struct(_rank(response).alias("rank"), F.xxhash64("body").alias("hash"), response.alias("response"), hrefs.alias("hrefs"))
    best = fetch_log.groupBy("url").agg(F.min(answer).alias("a"))
    return best.select("url", "a.response", "a.hrefs")


def _rank(response: Column) -> Column:
    return F.when(response == DOWNLOADED, F.lit(0)).when(response == NON_HTML, F.lit(1)).otherwise(F.lit(2))


def classify(
    requests: DataFrame, site: DataFrame, stored: DataFrame, filename: Column, order: str = "visit_seq"
) -> DataFrame:
    """Outcome of each request ``(url, <order>, …)`` plus its ``filename`` and ``owner``; see :func:`owned`."""
    named = (
        requests.withColumn("filename", filename)
        .join(site.select("url", "response"), "url", "left")
        .withColumn("response", F.coalesce("response", F.lit(FAILED)))
    )
    return owned(named, stored, order)


def owned(named: DataFrame, stored: DataFrame | None, order: str) -> DataFrame:
    """``outcome`` and ``owner`` of answered requests ``(url, <order>, filename, response, …)``.

    ``stored(filename, owner)`` are files that exist already. Requests run in ``order``,
    so the first successful one claims its file name and later ones of the same name are
    cache hits that see the claimant's content (``owner``).

    Owners are aggregated map-side to one row per name and joined back once. That join has
    no other operator on its key, so a name shared by a third of all URLs is split at run
    time like any skewed join.
    """
    claims = named.filter(F.col("response") == DOWNLOADED).select(
        "filename", F.col(order).alias("seq"), F.col("url").alias("claimant")
    )
    claims = claims.withColumn("stored_owner", F.lit(None).cast("string"))
    if stored is not None:
        # of all stored files only those asked for now
        kept = stored.join(named.select("filename").distinct(), "filename", "left_semi")
        claims = claims.unionByName(
            kept.select("filename", F.col("owner").alias("stored_owner")), allowMissingColumns=True
        )
    owners = (
        claims.groupBy("filename")
        .agg(
            F.min("seq").alias("claim_seq"),
            F.min_by("claimant", "seq").alias("claimant"),
            F.max("stored_owner").alias("stored_owner"),
        )
    )
    taken = F.col("stored_owner").isNotNull()
    later = F.coalesce(F.col(order) > F.col("claim_seq"), F.lit(False))
    claimed = F.when(F.col(order) >= F.col("claim_seq"), F.col("claimant"))
    return (
        named.join(owners, "filename", "left")
        .withColumn("outcome", F.when(taken | later, F.lit(CACHED)).otherwise(F.col("response")))
        .withColumn("owner", F.coalesce("stored_owner", claimed))
        .drop("response", "stored_owner", "claim_seq", "claimant")
    )


def cached_files(cached: DataFrame | None, like: DataFrame) -> DataFrame:
    """Stored pages as ``filename, owner, hrefs``; owners carry a prefix no URL can have."""
    if cached is None:
        return like.sparkSession.createDataFrame([], "filename string, owner string, hrefs array<string>")
    return cached.select(
        "filename", F.concat(F.lit("\x00"), F.col("filename")).alias("owner"), anchor_hrefs("html").alias("hrefs")
    )


def fetch_urls(
    urls: DataFrame, fetch_log: DataFrame, start_url: str, cached: DataFrame | None = None
) -> DataFrame:
    """Fetch exactly the given ``(url, visit_seq)`` rows: duplicates kept, no links followed."""
    response = response_outcome()
    answers = fetch_log.groupBy("url").agg(F.min(F.struct(_rank(response), response.alias("response"))).alias("a"))
    answers = answers.select("url", "a.response")
    stored = cached_files(cached, fetch_log).select("filename", "owner")
    return classify(urls.select("url", "visit_seq"), answers, stored, url_to_filename("url", F.lit(start_url)))


def crawl_counters(crawl: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files kept, cache hits, downloads and failures."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return crawl.groupBy(*(by or [])).agg(
        is_(CACHED, DOWNLOADED).alias("file_count"),
        is_(CACHED).alias("skipped_count"),
        is_(DOWNLOADED).alias("downloaded_count"),
        is_(FAILED).alias("failure_count"),
    )


def new_files(crawl: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """``filename, url, html`` of the pages this crawl stores."""
    saved = crawl.filter(F.col("outcome") == DOWNLOADED).select("url", "filename")
    pages = fetch_log.filter(response_outcome() == DOWNLOADED).select("url", F.col("body").alias("html"))
    best = pages.groupBy("url").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))
    return saved.join(best, "url").select("url", "filename", "html")
