import re

import pytest
from pyspark.sql import functions as F

from bindery.functions import text as t

SAMPLES = [
    "", " ", "one", " two words ", "a b", "　wide　", "x\x1cy", "x\x85y", "a\n\n\n\nb", "\n\n", "日本語の文",
    "tab\tnew\nline\r\nend", " em ", "a​b", "trail\n", "᠎", "\x1f", "l s",
]


def evaluate(spark, values, expr, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_word_count_follows_python_split(spark):
    assert evaluate(spark, SAMPLES, t.word_count) == [len(s.split()) for s in SAMPLES]


def test_strip_follows_python_strip(spark):
    assert evaluate(spark, SAMPLES, t.strip_text) == [s.strip() for s in SAMPLES]


def test_normalize_whitespace(spark):
    want = [re.sub(r"\n{3,}", "\n\n", s).strip() + "\n" for s in SAMPLES]
    assert evaluate(spark, SAMPLES, t.normalize_whitespace) == want


def test_universal_newlines(spark):
    assert evaluate(spark, ["a\r\nb\rc\nd\r\r\n"], t.universal_newlines) == ["a\nb\nc\nd\n\n"]


def test_utf8_decoding_flags_bad_bytes(spark):
    values = [b"plain", "é".encode(), b"\xff\xfe", b"\xef\xbb\xbfbom", b"cut\xc3", b""]
    assert evaluate(spark, values, t.decode_utf8, "binary") == ["plain", "é", None, "﻿bom", None, ""]


@pytest.mark.parametrize("unit", [1, 1 << 10, 1 << 20, 1 << 30])
def test_format_bytes_rounds_like_python(spark, unit):
    def model(n):
        if n < 1 << 10:
            return f"{n} B"
        power, name = (10, "KB") if n < 1 << 20 else (20, "MB") if n < 1 << 30 else (30, "GB")
        return f"{n / (1 << power):.1f} {name}"

    values = [0, *(int(unit * f) for f in (0.5, 0.999, 1, 1.25, 1.75, 2.3, 2.5, 3.05, 1023.95))]
    assert evaluate(spark, values, t.format_bytes, "long") == [model(v) for v in values]


def test_round_tenth_is_half_even_and_fills_nulls(spark):
    assert evaluate(spark, [None, 45.25, 0.75, 47.0], t.round_tenth, "double") == [0.0, 45.2, 0.8, 47.0]


def test_markdown_path(spark):
    names = ["a.html", "d/b.htm", "a.b.html", ".html", "d/.htm", "x.html/y.htm", "html"]
    want = ["a.md", "d/b.md", "a.b.md", ".html.md", "d/.htm.md", "x.html/y.md", "html"]
    assert evaluate(spark, names, t.markdown_path) == want


def test_path_order_is_part_wise(spark):
    paths = ["a.md", "a-b.md", "a/b.md", "b/a.md", "a/b/c.md", "B.md", "é.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(t.path_order("p")).collect()]
    assert got == sorted(paths, key=lambda p: p.split("/"))


def test_chunk_file_name_and_posix_path(spark):
    name = lambda c: t.chunk_file_name(F.lit("combined"), c, F.lit(".md"))
    assert evaluate(spark, [1, 42, 1000], name, "long") == ["combined-001.md", "combined-042.md", "combined-1000.md"]
    assert evaluate(spark, ["out\\md\\x"], t.posix_path) == ["out/md/x"]


def test_source_header(spark):
    assert evaluate(spark, ["body"], lambda c: t.with_source_header(F.lit("g/s.md"), c)) == ["Source: g/s.md\n\nbody"]
