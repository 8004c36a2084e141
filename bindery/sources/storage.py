"""Shared storage as tasks see it: folders listed level by level, files written by offset or as streams."""

from __future__ import annotations

import itertools
import os
import re
import stat
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from bindery.session import materialize

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?"
LISTED = "path string, rel_path string, n_bytes long"
_INFO = "path string, is_dir boolean, n_bytes long, modified long"
#: Files that one task reads, bytes of files that it reads, and bytes that it holds at a time.
_FILES_PER_TASK, _BYTES_PER_TASK, _BYTES_HELD = 4096, 64 << 20, 1 << 20


def is_local(path: str) -> bool:
    return not re.match(SCHEME_RE, path) or path.startswith("file:")


def storage(path: str):
    """File system, path within it, and what to put before its paths to get those that Spark reports."""
    from pyarrow import fs

    if is_local(path):
        return fs.LocalFileSystem(), os.path.abspath(re.sub(SCHEME_RE, "", path)), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    inner = inner.rstrip("/")
    return system, inner, path.rstrip("/").removesuffix(inner)


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; scheme and authority do not take part."""
    if not re.match(SCHEME_RE, root):
        root = os.path.abspath(root)
    base = re.sub(SCHEME_RE, "", root).rstrip("/") + "/"
    return F.substring(F.regexp_replace(path, SCHEME_RE, ""), len(base) + 1, 1 << 30)


def reached(path: str) -> bool:
    """Whether Arrow's file systems reach this storage; if not, only Spark does."""
    try:
        storage(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def is_missing(root: str) -> bool:
    from pyarrow import fs

    system, inner, _ = storage(root)
    return system.get_file_info(inner).type == fs.FileType.NotFound


def _in_folder(root: str, folder: str) -> Iterator[tuple]:
    """``path, is_dir, n_bytes, modified`` (microseconds) of what lies in a folder; of a local one, one at a time."""
    from pyarrow import fs

    system, _, prefix = storage(root)
    inner = folder.removeprefix(prefix)
    if not is_local(root):
        for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            yield prefix + i.path, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000
        return
    try:
        found = os.scandir(inner)
    except FileNotFoundError:
        return
    with found:
        for i in found:
            try:
                info = i.stat()
            except FileNotFoundError:  # gone since, or a link to nothing
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            yield prefix + i.path, is_dir, 0 if is_dir else info.st_size, info.st_mtime_ns // 1000


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, rel_path, n_bytes, modified`` of every file below ``root`` with one of the suffixes, whatever its size or name.

    Folders of one depth are listed in parallel and written before the next depth, so neither the driver nor a task
    holds more than the names of a folder.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                found = (i for i in _in_folder(root, folder) if i[1] or i[0].endswith(suffixes))
                while rows := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame(rows, columns=["path", "is_dir", "n_bytes", "modified"])

    _, inner, prefix = storage(root)
    folders = spark.createDataFrame([(prefix + inner,)], "path string")
    found = spark.createDataFrame([], _INFO)
    while True:
        level = materialize(folders.repartition("path").mapInPandas(look, _INFO), "listing")
        found = found.unionByName(level.filter("not is_dir"))
        folders = level.filter("is_dir").select("path")
        if folders.isEmpty():
            return found.select("path", relative_to(F.col("path"), root).alias("rel_path"), "n_bytes", "modified")


def some_at_a_time(rows: Iterator[tuple], content: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about ``_BYTES_HELD`` bytes in the column numbered ``content``, so that no worker holds more of it."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[content] or b"")
        if size >= _BYTES_HELD or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def with_content(listed: DataFrame, root: str) -> DataFrame:
    """Listed files (``path``, ``n_bytes`` and any other columns) with their ``content``; none where ``n_bytes`` is null."""
    schema = StructType([*listed.schema, StructField("content", BinaryType())])
    types = to_arrow_schema(schema)
    path_at, n_bytes_at = listed.columns.index("path"), listed.columns.index("n_bytes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, prefix = storage(root)

        def files() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    content = None if row[n_bytes_at] is None else b""
                    if row[n_bytes_at]:
                        with system.open_input_stream(row[path_at].removeprefix(prefix)) as stream:
                            content = stream.read()
                    yield *row, content

        yield from some_at_a_time(files(), len(types) - 1, types)

    return listed.mapInArrow(read, schema)


def read_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``path, content`` of every file below ``root`` with one of the suffixes, empty ones and hidden names too.

    Spark's own file source lists every file on the driver, opens a task for each 32 small ones, and passes over empty
    files and hidden names. Here the listing is a table, dealt to tasks by number and bytes.
    """
    if is_missing(root):
        raise FileNotFoundError(root)
    listed = list_files(spark, root, suffixes)
    n, total = listed.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-n // _FILES_PER_TASK), -(-total // _BYTES_PER_TASK))
    return with_content(listed.select("path", "n_bytes").repartition(n_tasks, "path"), root).select("path", "content")


# ---- writing ------------------------------------------------------------------------------


def _hidden(target: str, token: str) -> str:
    folder, _, leaf = target.rpartition("/")
    return f"{folder}/.{leaf}.{token}"


def write_pieces(files: DataFrame, pieces: DataFrame, root: str) -> DataFrame:
    """Files below ``root`` from ``pieces(rel_path, offset, text)``; ``files(rel_path, n_bytes)`` says what must come out.

    No task holds more than a piece of a file. Where storage can be written at any place (mounted folders), every task
    puts its own pieces at their offsets; elsewhere a file's pieces are sorted and written as one stream. A file
    appears under its name only when all of it is there, and only with the size it must have; repeating any task leaves
    the same files.
    """
    token = uuid.uuid4().hex
    if is_local(root):
        return _at_offsets(files, pieces, root, token)
    return _as_streams(files, pieces, root, token)


def _at_offsets(files: DataFrame, pieces: DataFrame, root: str, token: str) -> DataFrame:
    _, base, _ = storage(root)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for name, offset, text in zip(batch["rel_path"], batch["offset"], batch["text"], strict=True):
                part = _hidden(f"{base}/{name}", token)
                os.makedirs(os.path.dirname(part), exist_ok=True)
                data = memoryview(text.encode("utf-8", "surrogatepass"))
                sizes.append(len(data))
                at = int(offset)
                handle = os.open(part, os.O_CREAT | os.O_WRONLY, 0o666)
                try:
                    while data:
                        written = os.pwrite(handle, data, at)
                        data, at = data[written:], at + written
                finally:
                    os.close(handle)
            yield pd.DataFrame({"rel_path": batch["rel_path"], "n_bytes": sizes})

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, n_bytes, n_put in zip(batch["rel_path"], batch["n_bytes"], batch["n_put"], strict=True):
                target = f"{base}/{name}"
                part = _hidden(target, token)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if n_bytes == 0:
                    open(part, "wb").close()
                if not os.path.exists(part) and os.path.exists(target):
                    continue  # shown by an earlier attempt of this task
                if n_put != n_bytes or os.path.getsize(part) != n_bytes:
                    raise OSError(f"{name}: {n_put} of {n_bytes} bytes were written")
                os.replace(part, target)
            yield batch[["rel_path", "n_bytes"]]

    written = materialize(pieces.select("rel_path", "offset", "text").mapInPandas(put, "rel_path string, n_bytes long"), "pieces")
    sums = written.groupBy("rel_path").agg(F.sum("n_bytes").alias("n_put"))
    due = files.select("rel_path", F.col("n_bytes").cast("long")).join(sums, "rel_path", "left").fillna(0, ["n_put"])
    return materialize(due.mapInPandas(show, "rel_path string, n_bytes long"), "files")


def _as_streams(files: DataFrame, pieces: DataFrame, root: str, token: str) -> DataFrame:
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base, _ = storage(root)
        name, out, size, due = None, None, 0, 0

        def close() -> pd.DataFrame:
            out.close()
            if size != due:
                raise OSError(f"{name}: {size} of {due} bytes were written")
            system.move(_hidden(f"{base}/{name}", token), f"{base}/{name}")
            return pd.DataFrame({"rel_path": [name], "n_bytes": [size]})

        for batch in batches:
            for rel_path, n_bytes, text in zip(batch["rel_path"], batch["n_bytes"], batch["text"], strict=True):
                if rel_path != name:
                    if out is not None:
                        yield close()
                    name, size, due = rel_path, 0, int(n_bytes)
                    system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(_hidden(f"{base}/{name}", token))
                data = (text or "").encode("utf-8", "surrogatepass")
                out.write(data)
                size += len(data)
        if out is not None:
            yield close()

    rows = files.select("rel_path", "n_bytes").join(pieces.select("rel_path", "offset", "text"), "rel_path", "left")
    rows = rows.repartition("rel_path").sortWithinPartitions("rel_path", "offset")
    return materialize(rows.mapInPandas(put, "rel_path string, n_bytes long"), "files")


def delete_files(paths: DataFrame, root: str) -> None:
    """Remove ``paths(rel_path)`` below ``root``; one that is gone already is no error."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base, _ = storage(root)
        for batch in batches:
            for name in batch["rel_path"]:
                try:
                    system.delete_file(f"{base}/{name}")
                except FileNotFoundError:
                    pass
            yield batch

    materialize(paths.select("rel_path").mapInPandas(remove, "rel_path string"), "removed")
