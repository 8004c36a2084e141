"""Scans of HTML folders, ZIP archives, Markdown folders and report files."""

from __future__ import annotations

import itertools
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as t
from bindery.operators.report import parse_report
from bindery.session import materialize
from bindery.sources.storage import SCHEME_RE, read_files, relative_to, some_at_a_time

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_BYTES_PER_TASK = 128 << 20
_ENTRY = "archive string, name string, content binary, error string"
_ENTRY_TYPES = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def as_html_files(files: DataFrame, root: str, carry: Sequence[str] = ()) -> DataFrame:
    """``key, rel_path, content, is_text_file`` from a binary-file table (batch or stream), and its columns ``carry``."""
    return files.select(
        F.col("path").alias("key"),
        relative_to(F.col("path"), root).alias("rel_path"),
        "content",
        F.lit(True).alias("is_text_file"),
        *carry,
    )


def read_html_dir(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.html`` and ``*.htm`` below ``root`` (case-sensitive), empty ones too; none is an empty table."""
    return as_html_files(read_files(spark, root, (".html", ".htm")), root)


def read_html_files(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of an explicit path list, and the listed paths that do not exist.

    Paths match whether or not they carry a ``file:`` scheme.
    """
    def bare(c: str) -> Column:
        return F.regexp_replace(F.col(c), SCHEME_RE, "")

    keyed, asked = files.withColumn("_bare", bare("key")), wanted.withColumn("_bare", bare("key"))
    found = keyed.join(asked.select("_bare").distinct(), "_bare", "left_semi").drop("_bare")
    missing = asked.join(keyed.select("_bare"), "_bare", "left_anti").drop("_bare")
    return found, missing


def open_archive(path: str) -> zipfile.ZipFile:
    """Open an archive by seeking in shared storage, so it never has to fit in memory."""
    from pyarrow import fs

    if re.match(r"^(file:|/)", path):
        return zipfile.ZipFile(fs.LocalFileSystem().open_input_file(re.sub(SCHEME_RE, "", path)))
    system, inner = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(system.open_input_file(inner))


#: An archive's own path, and the entry that a key names in it, if any.
_ZIP_KEY = r"(?s)^(.*?\.zip)(?:!(.*))?$"


def is_zip_key(key: Column) -> Column:
    return key.rlike(_ZIP_KEY)


def read_zip(spark: SparkSession, paths: str | list[str], wanted: DataFrame | None = None) -> DataFrame:
    """HTML entries of ZIP archives: ``key, rel_path, archive, content, is_text_file, error``.

    With ``wanted(key)``, keys of an earlier read, only these entries (or, where a key is an archive's, all of its
    entries) are read, and only archives that hold any are opened.

    Archives are listed first. The entries are then spread in stretches of an archive's
    bytes, each seeking to its own entries, so an archive of normal size is opened once
    more and a huge one is read in parallel. Keys are ``archive!entry``. An archive that
    cannot be listed is one row with its error, under its own path and name.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(paths).select("path")
    if wanted is not None:
        asked = wanted.select(F.regexp_extract("key", _ZIP_KEY, 1).alias("path"), "key").distinct()
        archives = archives.join(asked.select("path"), "path", "left_semi")

    def list_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    with open_archive(path) as z:
                        found = [
                            (path, i.filename, i.file_size, None)
                            for i in z.infolist()
                            if i.filename.endswith((".html", ".htm")) and not i.filename.startswith("__MACOSX")
                        ]
                except Exception as exc:  # a damaged archive is a failed row
                    found = [(path, None, 0, f"{type(exc).__name__}: {exc}")]
                rows = pd.DataFrame(found, columns=["archive", "name", "n_bytes", "error"])
                rows["stretch"] = rows["n_bytes"].cumsum() // _BYTES_PER_TASK
                yield rows

    def read_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            for batch in batches:
                pairs = zip(batch.column("archive").to_pylist(), batch.column("name").to_pylist(), strict=True)
                for path, of_archive in itertools.groupby(pairs, lambda p: p[0]):
                    with open_archive(path) as z:
                        for _, name in of_archive:
                            try:
                                yield path, name, z.read(name), None
                            except Exception as exc:  # a damaged entry is a failed row
                                yield path, name, None, f"{type(exc).__name__}: {exc}"

        yield from some_at_a_time(entries(), 2, _ENTRY_TYPES)

    columns = "archive string, name string, n_bytes long, error string, stretch long"
    listed = archives.mapInPandas(list_entries, columns)
    if wanted is not None:
        of_entry = listed.withColumn("key", F.concat_ws("!", "archive", "name"))
        whole = of_entry.join(asked.select(F.col("path").alias("archive"), F.col("key").alias("_key")).filter("archive = _key"), "archive", "left_semi")
        single = of_entry.join(asked.select("key"), "key", "left_semi")
        listed = whole.unionByName(single).distinct().select(*listed.columns)
    listed = materialize(listed, "entries")
    total = listed.agg(F.sum("n_bytes")).first()[0] or 0
    # a fixed count: names are tiny, so sizing tasks by shuffled bytes would leave too few
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-total // _BYTES_PER_TASK))
    readable = listed.filter("error is null").repartition(n_tasks, "archive", "stretch")
    entries = readable.sortWithinPartitions("archive", "name").mapInArrow(read_entries, _ENTRY)
    broken = listed.filter("error is not null").withColumn("content", F.lit(None).cast("binary"))
    return entries.unionByName(broken.select("archive", "name", "content", "error")).select(
        F.concat_ws("!", "archive", "name").alias("key"),
        F.coalesce("name", F.substring_index("archive", "/", -1)).alias("rel_path"),
        "archive",
        "content",
        F.lit(False).alias("is_text_file"),
        "error",
    )


def read_markdown_dir(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, body, status`` of all ``*.md`` below ``root``, empty ones too."""
    body = t.universal_newlines(t.decode_utf8("content"))
    return read_files(spark, root, (".md",)).select(
        relative_to(F.col("path"), root).alias("rel_path"),
        body.alias("body"),
        F.when(body.isNull(), F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """One ``report`` struct per JSON file."""
    return spark.read.text(path, wholetext=True).select(parse_report(F.col("value")).alias("report"))
