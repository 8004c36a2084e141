"""Breadth-first site traversal as one join per level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.urls import derive_url_prefix, url_to_filename
from bindery.operators.fetch import CACHED, DOWNLOADED, FAILED, cached_files, owned, site_table
from bindery.operators.links import links_of
from bindery.operators.order import ranked, with_ordinal
from bindery.session import materialize, materialize_bucketed

MAX_PAGES = 100  # fixed value: default page budget


class Runs:
    """Rows that only grow, as few written tables: ``FAN`` tables of one tier are merged to one of the next.

    After n additions there are at most ``FAN`` times log(n) tables, and a row has been rewritten log(n) times, so what
    a level has to look through does not grow with the number of levels before it.
    """

    FAN = 4

    def __init__(self, label: str):
        self.label, self.tiers = label, [[]]

    def add(self, table: DataFrame) -> None:
        self.tiers[0].append(table)
        for tier, tables in enumerate(self.tiers):
            if len(tables) < self.FAN:
                break
            if tier + 1 == len(self.tiers):
                self.tiers.append([])
            self.tiers[tier + 1].append(materialize(reduce(DataFrame.unionByName, tables), self.label))
            tables.clear()

    def rows(self) -> DataFrame | None:
        tables = [t for tier in self.tiers for t in tier]
        return reduce(DataFrame.unionByName, tables) if tables else None


def traverse_site(
    fetch_log: DataFrame,
    start_url: str,
    url_prefix: str | None = None,
    max_pages: int = MAX_PAGES,
    cached: DataFrame | None = None,
) -> DataFrame:
    """Visit ``start_url`` and everything in scope reachable from it.

    Returns ``url, visit_seq, depth, filename, outcome``. The budget counts every visited
    URL, whatever its outcome. Page bodies are read once, and only of URLs in scope. Their
    links are resolved once, too, and stored with the URL's answer and file name in buckets
    by URL, so a level is joined to the site without moving the site.
    """
    spark = fetch_log.sparkSession
    if not url_prefix:
        url_prefix = spark.range(1).select(derive_url_prefix(F.lit(start_url))).first()[0]
    in_scope = F.startswith(F.col("url"), F.lit(url_prefix)) | (F.col("url") == start_url)
    filename = url_to_filename("url", F.lit(start_url))
    links = links_of(F.col("hrefs"), F.col("url"), F.lit(url_prefix))
    pages = site_table(fetch_log.filter(in_scope))
    site = materialize_bucketed(pages.select("url", "response", "hrefs", links.alias("links")), "site", "url")
    cache = cached_files(cached, fetch_log)
    contents = site.select(F.col("url").alias("owner"), "hrefs")
    stored, visited = Runs("stored"), Runs("visited")
    if cached is not None:
        cache = materialize(cache, "cache")
        contents = contents.unionByName(cache.select("owner", "hrefs"))
        stored.add(cache.select("filename", "owner"))

    answers = site.select("url", "response", "links")
    place = F.struct(F.col("gid").alias("parent"), F.col("pos"))
    frontier = _start(spark, start_url)
    levels: list[DataFrame] = []
    n_visited = 0
    while n_visited < max_pages:
        # written before it is used several times
        asked = frontier.join(answers, "url", "left").withColumn("filename", filename)
        asked = materialize(asked.withColumn("response", F.coalesce("response", F.lit(FAILED))), "asked")
        n_level = asked.count()
        if n_level == 0:
            break
        # requests of a level run in the order (parent's place, position of the link on it)
        level = ranked(owned(asked, stored.rows(), "at"), [F.col("at")], "level")
        numbered = with_ordinal(level.drop("links"), "nth").filter(F.col("nth") < max_pages - n_visited)
        levels.append(
            numbered.select(
                "url",
                (F.col("nth") + n_visited).alias("visit_seq"),
                F.lit(len(levels)).alias("depth"),
                "filename",
                "outcome",
            )
        )
        n_visited += n_level
        if n_visited >= max_pages:
            break
        downloaded = level.filter(F.col("outcome") == DOWNLOADED)
        stored.add(downloaded.select("filename", F.col("url").alias("owner")))
        visited.add(level.select("url"))
        # a page that was stored already shows the stored page's anchors, resolved against its own URL
        hits = level.filter(F.col("outcome") == CACHED).select("gid", "url", "owner").join(contents, "owner")
        seen = downloaded.select("gid", "links").unionByName(hits.select("gid", links.alias("links")))
        # map-side min keeps a URL linked from everywhere to one row per task
        found = seen.select("gid", F.posexplode("links").alias("pos", "link")).groupBy(F.col("link").alias("url"))
        frontier = found.agg(F.min(place).alias("at")).join(visited.rows(), "url", "left_anti")
    if not levels:
        return spark.createDataFrame([], "url string, visit_seq long, depth int, filename string, outcome string")
    return reduce(DataFrame.unionByName, levels)


def _start(spark: SparkSession, start_url: str) -> DataFrame:
    at = F.struct(F.lit(0).cast("long").alias("parent"), F.lit(0).alias("pos"))
    return spark.range(0, 1, 1, 1).select(F.lit(start_url).alias("url"), at.alias("at"))
