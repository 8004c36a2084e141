"""Link discovery: anchors to canonical, in-scope, per-page distinct URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.html import anchor_hrefs
from bindery.functions.urls import canonical_url, let, parts_struct, resolve_against

# Raw href beginnings that are never followed.
SKIPPED_SCHEMES = ("mailto:", "javascript:", "tel:")


def is_followed(href: Column) -> Column:
    skipped = F.lit(False)
    for scheme in SKIPPED_SCHEMES:
        skipped = skipped | F.startswith(href, F.lit(scheme))
    return ~skipped


def links_of(hrefs: Column, base: Column, url_prefix: Column) -> Column:
    """Array of canonical links: first occurrence of each, in document order.

    Filters run on the array, before anything is exploded.
    """
    followed = F.filter(hrefs, is_followed)
    absolute = let(
        parts_struct(base),
        lambda b: F.transform(followed, lambda h: canonical_url(resolve_against(b, base, h))),
    )
    return F.array_distinct(F.filter(absolute, lambda u: F.startswith(u, url_prefix)))


def discover_links(
    pages: DataFrame, url_prefix: Column | str, url: str = "url", html: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """One row per link: the ``keep`` columns (default ``src_url``), ``pos`` and ``url``."""
    prefix = F.lit(url_prefix) if isinstance(url_prefix, str) else url_prefix
    kept = keep or ["src_url"]
    found = pages.withColumn("src_url", F.col(url)).select(
        *kept, links_of(anchor_hrefs(html), F.col(url), prefix).alias("links")
    )
    # the plain form would make the optimizer filter on size(links), computing the links twice
    exploded = found.select(*kept, F.posexplode_outer("links").alias("pos", "url"))
    return exploded.filter(F.col("url").isNotNull())
