"""URL scalars as built-in column expressions (no Python worker involved)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B, with the scheme restricted to legal scheme characters.
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


class UrlParts(NamedTuple):
    scheme: Column
    netloc: Column
    path: Column
    query: Column
    fragment: Column


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _cleaned(url: Column) -> Column:
    """Leading control characters and embedded tabs and newlines are ignored."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


def url_parts(url: Column | str) -> UrlParts:
    """Split a URL into plain columns."""
    url = _cleaned(_col(url))
    scheme, *rest = (F.regexp_extract(url, URL_RE, i) for i in range(1, 6))
    return UrlParts(F.lower(scheme), *rest)


def origin(url: Column | str) -> Column:
    u = url_parts(url)
    return F.concat(u.scheme, F.lit("://"), u.netloc)


def derive_url_prefix(start_url: Column | str) -> Column:
    """Crawl scope of a start URL: everything up to the last ``/`` of its path."""
    u = url_parts(start_url)
    folder = (
        F.when(F.contains(u.path, F.lit("/")), F.regexp_extract(u.path, "(?s)^(.*/)", 1))
        .when(u.path == "", F.lit(""))
        .otherwise(F.concat(u.path, F.lit("/")))
    )
    return F.concat(u.scheme, F.lit("://"), u.netloc, folder)


def scope_prefix(url_prefix: Column | str | None, start_url: Column) -> Column:
    """An explicit prefix if given and non-empty, otherwise derived from the start URL."""
    given = F.lit(url_prefix) if url_prefix is None or isinstance(url_prefix, str) else url_prefix
    return F.coalesce(F.nullif(given.cast("string"), F.lit("")), derive_url_prefix(start_url))


def url_to_filename(url: Column | str, base_url: Column | str) -> Column:
    """File name a page is stored under; host, query and fragment do not take part."""
    path = F.btrim(url_parts(url).path, F.lit("/"))
    base = F.btrim(url_parts(base_url).path, F.lit("/"))
    name = F.translate(F.regexp_replace(path, r"[^\p{L}\p{N}_\-./]", "_"), "/", "_")
    return (
        F.when((path == "") | (path == base), F.lit("index.html"))
        .when(F.endswith(name, F.lit(".html")), name)
        .otherwise(F.concat(name, F.lit(".html")))
    )


def canonical_url(url: Column | str) -> Column:
    """Drop the fragment, then the query."""
    return F.substring_index(F.substring_index(_col(url), "#", 1), "?", 1)


def parts_struct(url: Column | str) -> Column:
    """``scheme, netloc, path, params, query, fragment`` as one struct, parsed once per use."""
    path, params = r"(?s)^((?:.*/)?[^/;]*)", r"(?s)^(?:.*/)?[^/;]*;([^/]*)\z"

    def split(u: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(u, URL_RE, 1)).alias("scheme"),
            F.regexp_extract(u, URL_RE, 2).alias("netloc"),
            F.regexp_extract(F.regexp_extract(u, URL_RE, 3), path, 1).alias("path"),
            F.regexp_extract(F.regexp_extract(u, URL_RE, 3), params, 1).alias("params"),
            F.regexp_extract(u, URL_RE, 4).alias("query"),
            F.regexp_extract(u, URL_RE, 5).alias("fragment"),
        )

    return let(_cleaned(_col(url)), split)


def _merge_paths(base_path: Column, path: Column) -> Column:
    """Resolve ``path`` against ``base_path`` with ``.`` and ``..`` segments removed."""

    def segments(parts: Column) -> Column:
        folder = F.split(F.regexp_replace(base_path, r"[^/]*\z", ""), "/")
        middle = F.concat(folder, F.slice(parts, F.lit(1), F.size(parts) - 1))
        relative = F.concat(
            F.array(F.lit("")), F.filter(middle, lambda s: s != ""), F.slice(parts, F.lit(-1), F.lit(1))
        )
        return F.when(F.startswith(path, F.lit("/")), parts).otherwise(relative)

    def step(acc: Column, s: Column) -> Column:
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s == "..", shorter).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(let(F.split(path, "/"), segments), F.array().cast("array<string>"), step)
    open_end = F.when(path.rlike(r"(^|/)\.\.?\z"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(kept, open_end), "/")
    # a leading ".." can eat the root segment; the path stays absolute
    return F.regexp_replace(joined, "^(?!/)", "/")


def _build(netloc: Column, path: Column, params: Column, query: Column, b: Column, u: Column) -> Column:
    def part(mark: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(mark), c)).otherwise(F.lit(""))

    return F.concat(
        b["scheme"], F.lit("://"), netloc, path, part(";", params), part("?", query), part("#", u["fragment"])
    )


def resolve_against(b: Column, base: Column, href: Column) -> Column:
    """Absolute URL of ``href``, given the page URL ``base`` and ``b = parts_struct(base)``.

    The first two branches cover almost every link of a real page with a pattern test
    and a concatenation; the last is full reference resolution.
    """

    def general(u: Column) -> Column:
        plain_query = F.when(u["query"] != "", u["query"]).otherwise(b["query"])
        return (
            F.when((u["scheme"] != "") & (u["scheme"] != b["scheme"]), href)
            .when(u["netloc"] != "", _build(u["netloc"], u["path"], u["params"], u["query"], b, u))
            .when(
                (u["path"] == "") & (u["params"] == ""),
                _build(b["netloc"], b["path"], b["params"], plain_query, b, u),
            )
            .otherwise(_build(b["netloc"], _merge_paths(b["path"], u["path"]), u["params"], u["query"], b, u))
        )

    return (
        F.when(
            href.rlike(r"^(?!.*/\.)/(?!/)[^\x00-\x20;?#]*\z"),
            F.concat(b["scheme"], F.lit("://"), b["netloc"], href),
        )
        .when(href.rlike(r"^https?://[^\x00-\x20;?#]+\z"), href)
        .when(href == "", base)
        .otherwise(let(parts_struct(href), general))
    )


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute URL of ``href`` on the page ``base`` (http/https pages)."""
    return let(parts_struct(base), lambda b: resolve_against(b, _col(base), _col(href)))
