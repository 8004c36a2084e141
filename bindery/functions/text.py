"""Text, size and path scalars as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() and str.strip() treat as white space.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The same set in the pattern syntax of the JVM; category Z covers all of it beyond Latin-1.
SPACE_RE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD_RE = r"[^\s\x1c-\x1f\x85\p{Z}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c: Column | str) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(_col(c), F.lit(WORD_RE)).cast("long")


def strip_text(c: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalize_whitespace(c: Column | str) -> Column:
    """Collapse runs of blank lines, trim, and end in exactly one newline."""
    return F.concat(strip_text(F.regexp_replace(_col(c), "\n{3,}", "\n\n")), F.lit("\n"))


def universal_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def decode_utf8(content: Column | str) -> Column:
    """Binary to string; null where the bytes are not valid UTF-8."""
    return F.try_validate_utf8(_col(content).cast("string"))


def with_source_header(rel_path: Column | str, body: Column | str) -> Column:
    return F.concat(F.lit("Source: "), _col(rel_path), F.lit("\n\n"), _col(body))


def path_order(c: Column | str) -> Column:
    """Sort key that orders paths part by part.

    NUL cannot occur in a path and sorts below everything that can, so a plain string
    comparison of the key compares part after part.
    """
    return F.replace(_col(c), F.lit("/"), F.lit("\x00"))


def posix_path(c: Column | str) -> Column:
    return F.translate(_col(c), "\\", "/")


def markdown_path(c: Column | str) -> Column:
    """Replace the last HTML suffix by ``.md``; a bare ``.html`` name keeps its name."""
    c = _col(c)
    return F.when(c.rlike(r"(^|/)\.html?\z"), F.concat(c, F.lit(".md"))).otherwise(
        F.regexp_replace(c, r"\.html?\z", ".md")
    )


def round_tenth(c: Column | str) -> Column:
    """Half-even rounding to one decimal; a missing duration is 0.0."""
    return F.bround(F.coalesce(_col(c).cast("double"), F.lit(0.0)), 1)


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.bround(c, 1))


def format_bytes(c: Column | str) -> Column:
    size = _col(c).cast("long")
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(size < kb, F.format_string("%d B", size))
        .when(size < mb, F.concat(_one_decimal(size / kb), F.lit(" KB")))
        .when(size < gb, F.concat(_one_decimal(size / mb), F.lit(" MB")))
        .otherwise(F.concat(_one_decimal(size / gb), F.lit(" GB")))
    )


def chunk_file_name(stem: Column | str, chunk_no: Column | str, suffix: Column | str) -> Column:
    return F.format_string("%s-%03d%s", _col(stem), _col(chunk_no), _col(suffix))
