"""HTML pattern scalars that stay inside the JVM."""

from __future__ import annotations

import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.urls import let

# Comments and raw-text elements never contain live markup.
_OPAQUE_RE = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|iframe|xmp)\b[^>]*+(?:>.*?(?:</\1\s*>|\z)|\z)"

# A whole anchor start tag with its href attribute, if any. Possessive, and consumed to its end even where it never
# ends, so that no part of a page is read twice.
_ANCHOR_RE = (
    r"(?is)<a(?=[\s/>])"
    r"(?:[\s/]++(?!href[\s=/>])[^\s=>/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+"
    r"(?:[\s/]++(href(?=[\s=/>])(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+))?+[^>]*+"
)
_HREF_NAME_RE = r"(?i)^href(?:\s*+=\s*+)?+"
_ENTITY_RE = r"(?s)&#?[0-9A-Za-z]+;?|[^&]+|&"


def without_opaque(html_col: Column | str) -> Column:
    c = F.col(html_col) if isinstance(html_col, str) else html_col
    return F.regexp_replace(c, _OPAQUE_RE, "")


# A map is searched entry by entry, so names are dealt to small ones.
_NAME_MAPS = 256


def _named(name: Column) -> Column:
    """Text of a named reference (``amp;``), or null."""
    maps: list[dict[str, str]] = [{} for _ in range(_NAME_MAPS)]
    for known, text in html.entities.html5.items():
        maps[zlib.crc32(known.encode()) % _NAME_MAPS][known] = text
    dealt = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return F.try_element_at(F.get(dealt, (F.crc32(name) % _NAME_MAPS).cast("int")), name)


def _decode_reference(token: Column) -> Column:
    decimal = F.regexp_extract(token, r"^&#([0-9]{1,7});?$", 1)
    hexadecimal = F.regexp_extract(token, r"(?i)^&#x([0-9a-f]{1,6});?$", 1)
    number = F.coalesce(F.nullif(decimal, F.lit("")), F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10))
    return (
        F.when(~token.rlike("^&#?[0-9A-Za-z]"), token)
        .when(token == "&amp;", F.lit("&"))
        .when(F.startswith(token, F.lit("&#")), F.coalesce(let(number.cast("int"), _code_point), token))
        .otherwise(F.coalesce(let(F.substr(token, F.lit(2)), _named), token))
    )


def _code_point(n: Column) -> Column:
    """One code point as UTF-8 (``chr`` covers single bytes only)."""

    def octets(*values: Column) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(v), 2, "0") for v in values])).cast("string")

    def tail(shift: int) -> Column:
        return F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))

    def head(shift: int, mark: int) -> Column:
        return F.shiftright(n, shift).bitwiseOR(F.lit(mark))

    return (
        F.when(n < 0x80, octets(n))
        .when(n < 0x800, octets(head(6, 0xC0), tail(0)))
        .when(n < 0x10000, octets(head(12, 0xE0), tail(6), tail(0)))
        .when(n < 0x110000, octets(head(18, 0xF0), tail(12), tail(6), tail(0)))
    )


def unescape_entities(c: Column) -> Column:
    """Decode character references; text without ``&`` is passed through untouched."""
    tokens = F.regexp_extract_all(c, F.lit(_ENTITY_RE), 0)
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(
        F.array_join(F.transform(tokens, _decode_reference), "")
    )


def anchor_hrefs(html_col: Column | str) -> Column:
    """Decoded ``href`` values of all anchors, in document order; anchors without one are skipped."""
    found = F.regexp_extract_all(without_opaque(html_col), F.lit(_ANCHOR_RE), 1)
    values = F.transform(F.filter(found, lambda h: h != ""), lambda h: F.regexp_replace(h, _HREF_NAME_RE, ""))
    return F.transform(values, lambda h: unescape_entities(F.regexp_replace(h, "^[\"']|[\"']$", "")))
