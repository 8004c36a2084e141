"""One legal JSON report of any size: written from ordered pieces, read back line by line.

The document is the one that :func:`bindery.operators.report.report_json` describes, one list or map entry to a line.
Its entries are rows throughout: they are range-sorted, get their places in the file by running sums of their lengths,
and are written there by the tasks that hold them. Reading splits the file like any text; the few lines that are no
entries say which list each entry belongs to.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as t
from bindery.operators.order import prefix_sums, ranked
from bindery.operators.report import LINES
from bindery.session import materialize
from bindery.sources.storage import write_pieces

_FIELDS = "step_name file_count total_bytes elapsed_seconds output_path skipped_count downloaded_count failure_count".split()
_REQUIRED = _FIELDS[:5]
#: Lines that are no entries: a few per step. A file with more is laid out otherwise.
SKELETON = 20_000


def _quoted(key: Column) -> Column:
    # the text between {"k": and }
    whole = F.to_json(F.struct(key.alias("k")))
    return F.substring(whole, F.lit(6), F.char_length(whole) - 6)


def document_pieces(
    steps: list[DataFrame],
    words: dict[str, DataFrame] | None = None,
    failures: dict[str, DataFrame] | None = None,
    total_elapsed_seconds: float | None = None,
    command: str = "",
) -> DataFrame:
    """``offset, text`` of the whole document; arguments as for :func:`report_lines`.

    Each entry of ``words`` and ``failures`` is a row of its own, in key order within its list. A single step's own
    seconds serve as the total.
    """
    spark = steps[0].sparkSession
    words, failures = words or {}, failures or {}
    parts: list[DataFrame] = []
    frame: list[tuple[int, str, str]] = []

    def fixed(place: int, text: str) -> None:
        frame.append((place, "", text))

    # the places of lists and of what closes them, by number; entries are preceded by what parts them
    lists: dict[int, str] = {}
    fixed(0, '{\n  "steps": [')
    for nth, step in enumerate(steps):
        at = 10 * (nth + 1)
        body = [F.concat(F.lit(f'      "{c}": '), _value(step, c)) for c in _FIELDS]
        opened = F.concat(F.lit("\n    {\n" if nth == 0 else ",\n    {\n"), F.concat_ws(",\n", *body), F.lit(',\n      "output_word_counts": {'))
        parts.append(step.select(F.lit(at), F.lit(""), opened))
        name = step.select("step_name").first()[0]
        if name in words:
            entry = F.concat(F.lit("        "), _quoted(F.col("key")), F.lit(": "), F.col("n_words").cast("long").cast("string"))
            parts.append(words[name].select(F.lit(at + 1), "key", entry))
        lists[at + 1] = "      }"
        fixed(at + 2, "")
        fixed(at + 3, "\n    }")
    end = 10 * (len(steps) + 1)
    seconds = F.lit(total_elapsed_seconds).cast("double") if total_elapsed_seconds is not None else F.col("elapsed_seconds")
    total = F.concat(F.lit('\n  ],\n  "total_elapsed_seconds": '), t.round_tenth(seconds).cast("string"))
    parts.append(steps[0].select(F.lit(end), F.lit(""), total))
    for i, kind in enumerate(("crawl", "convert")):
        at = end + 10 * (i + 1)
        fixed(at, f',\n  "{kind}_failures": [')
        if kind in failures:
            parts.append(failures[kind].select(F.lit(at + 1), "key", F.concat(F.lit("    "), _quoted(F.col("key")))))
        lists[at + 1] = "  ]"
        fixed(at + 2, "")
    fixed(end + 30, f',\n  "command": {json.dumps(command, ensure_ascii=False)}\n}}\n')

    parts.append(spark.createDataFrame(frame, "place int, key string, text string").coalesce(1))
    rows = reduce(DataFrame.unionAll, parts).toDF("place", "key", "text")
    rows = ranked(rows, [F.col("place"), F.col("key")], "report")
    # one row for each list: a few per step
    held = rows.filter(F.col("place").isin(*lists)).groupBy("place").agg(F.min("gid").alias("first"))
    first = {r["place"]: r["first"] for r in held.collect()}
    text = F.col("text")
    for at, close in lists.items():
        if at in first:
            text = F.when(F.col("place") == at, F.concat(F.when(F.col("gid") == first[at], "\n").otherwise(",\n"), "text")).otherwise(text)
        done = "\n" + close if at in first else close.strip()
        text = F.when(F.col("place") == at + 1, F.lit(done)).otherwise(text)
    sized = rows.select("gid", text.alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    return prefix_sums(sized, "size", "offset").select("offset", "text", "size")


def _value(step: DataFrame, column: str) -> Column:
    kind = dict(step.dtypes)[column]
    return _quoted(F.col(column)) if kind == "string" else F.coalesce(F.col(column).cast("string"), F.lit("null"))


def write_report_document(path: str, steps: list[DataFrame], *details, **named) -> None:
    """Write the document of :func:`document_pieces` to the file ``path``."""
    folder, _, name = path.rpartition("/")
    pieces = materialize(document_pieces(steps, *details, **named), "report-pieces")
    files = pieces.agg(F.sum("size").alias("n_bytes")).select(F.lit(name).alias("rel_path"), "n_bytes")
    write_pieces(files, pieces.select(F.lit(name).alias("rel_path"), "offset", "text"), folder)


def read_report_document(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The report without its lists and maps, and these as rows ``kind, step_name, key, n_words, step, ordinal``.

    Rows are those of :func:`report_lines`, with ``ordinal`` rising in the order of the file, so failures can be given
    to :func:`select_retry`. Defaults and required fields as for :func:`parse_report`.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", ",$", "").alias("line"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
    )
    lines = materialize(lines, "report-lines")
    counted = F.col("line").rlike(r'^ {8}"')
    listed = F.col("line").rlike(r'^ {4}"')
    outline = lines.filter(~counted & ~listed).orderBy("at").limit(SKELETON + 1).collect()
    if len(outline) > SKELETON:
        raise ValueError(f"not a report with one entry to a line: {path}")
    report = json.loads(_joined([r["line"] for r in outline]))
    for field in ("steps", "total_elapsed_seconds"):
        if report.get(field) is None:
            raise ValueError(f"not a report: {field} is missing")
    for step in report["steps"]:
        if missing := [f for f in _REQUIRED if step.get(f) is None]:
            raise ValueError(f"report step lacks a required field: {missing}")
    names = iter(step["step_name"] for step in report["steps"])
    list_of, map_of = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in outline:  # each entry belongs to the last list or map opened before it
        after = F.col("at") > F.struct(F.lit(r["at"]["block"]).alias("block"), F.lit(r["at"]["row"]).alias("row"))
        if r["line"].startswith('      "output_word_counts"'):
            map_of = F.when(after, F.lit(next(names))).otherwise(map_of)
        elif r["line"].startswith('  "') and r["line"].endswith("["):
            list_of = F.when(after, F.lit(r["line"].split('"')[1])).otherwise(list_of)
    entry = F.from_json(F.concat(F.lit("{"), F.trim("line"), F.lit("}")), "map<string,bigint>")
    key = F.from_json(F.concat(F.lit('{"k":'), F.trim("line"), F.lit("}")), "k string")["k"]
    none, no_count = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    ordinal = F.col("at.block") * (1 << 20) + F.col("at.row")
    rows = [
        lines.filter(counted).select(F.lit("2 words"), map_of, F.map_keys(entry)[0], F.map_values(entry)[0], none, ordinal),
        lines.filter(listed).select(
            F.concat(F.lit("3 "), F.replace(list_of, F.lit("_failures"), F.lit(" failure"))), none, key, no_count, none, ordinal
        ),
    ]
    steps = [
        (i, s["step_name"], json.dumps({k: s.get(k, 0) for k in _FIELDS}, ensure_ascii=False)) for i, s in enumerate(report["steps"])
    ]
    head = spark.createDataFrame(steps, "nth int, name string, body string")
    head = head.select(F.lit("1 step"), "name", F.format_string("%04d", "nth"), no_count, "body", F.col("nth").cast("long"))
    columns = [*(f.split()[0] for f in LINES.split(", ")), "ordinal"]
    outer = {"crawl_failures": [], "convert_failures": [], "command": "", **report}
    return outer, reduce(DataFrame.unionAll, [head, *rows]).toDF(*columns)


def _joined(lines: list[str]) -> str:
    """The lines without trailing commas as one document again."""
    out: list[str] = []
    for line in lines:
        # whatever follows a finished value stands after a comma
        if out and line.lstrip()[:1] not in ("]", "}") and not out[-1].endswith(("{", "[")):
            out.append(",")
        out.append(line)
    return "\n".join(out)
