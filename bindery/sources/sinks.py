"""Writers: page store, Markdown table, bundles, reports and one-file-per-row export."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.operators.combine import Pieces
from bindery.operators.report import report_json
from bindery.session import materialize, small_batches
from bindery.sources.storage import delete_files, storage, write_pieces

_MANIFESTS, _MANIFEST = "_manifests", "corpus string, rel_path string"
PAGE_STORE = "filename string, url string, html string"


def read_page_store(spark, path: str) -> DataFrame:
    """Stored pages; a store that was never written is empty."""
    try:
        return spark.read.schema(PAGE_STORE).parquet(path).select("filename", "url", "html")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAGE_STORE)


def append_pages(pages: DataFrame, path: str) -> None:
    """Add pages whose file name is not stored yet; of one name the least URL, then the least text, is stored."""
    known = read_page_store(pages.sparkSession, path).select("filename")
    first = pages.groupBy("filename").agg(F.min(F.struct("url", "html")).alias("page"))
    first.select("filename", "page.url", "page.html").join(known, "filename", "left_anti").write.mode("append").parquet(path)


def write_markdown(results: DataFrame, path: str) -> None:
    """Converted pages as a table keyed by ``md_path``."""
    results.filter(F.col("status") == "ok").select("md_path", "markdown", "n_words", "n_bytes").write.mode(
        "overwrite"
    ).parquet(path)


def write_bundles(chunks: DataFrame, path: str) -> None:
    """Bundles partitioned by corpus; a re-run replaces a corpus whole, leaving no stale chunk.

    The rows already lie spread by corpus and chunk, so the texts are not moved again.
    """
    (
        chunks.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("corpus")
        .parquet(path)
    )


def read_manifest(spark, root: str) -> DataFrame:
    """``corpus, rel_path`` of all files that the current generation below ``root`` consists of."""
    system, base, _ = storage(root)
    try:
        with system.open_input_stream(f"{base}/{_MANIFESTS}/current") as pointer:
            generation = pointer.read().decode()
    except FileNotFoundError:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/{_MANIFESTS}/{generation}")


def export_bundles(bundles: Pieces, root: str) -> DataFrame:
    """Write bundles to files below ``root`` as a new generation of their corpora; returns ``rel_path, n_bytes``.

    A manifest lists the files of every corpus. It is switched at once, when all files stand; files that the old one
    lists for an exported corpus and the new one does not (``-003`` of what has two chunks now, a plain name of what is
    split now) are removed after that. Other files below ``root`` are left alone.
    """
    spark = bundles.files.sparkSession
    done = write_pieces(bundles.files, bundles.pieces, root)
    now = bundles.files.select("corpus", "rel_path")
    old = materialize(read_manifest(spark, root), "old-manifest")
    exported = now.select("corpus").distinct()
    generation = uuid.uuid4().hex
    old.join(exported, "corpus", "left_anti").unionByName(now).write.parquet(f"{root}/{_MANIFESTS}/{generation}")
    system, base, _ = storage(root)
    part = f"{base}/{_MANIFESTS}/.current.{generation}"
    with system.open_output_stream(part) as pointer:
        pointer.write(generation.encode())
    system.move(part, f"{base}/{_MANIFESTS}/current")
    stale = old.join(exported, "corpus", "left_semi").join(now, "rel_path", "left_anti")
    delete_files(stale, root)
    return done


def write_report(report: DataFrame, path: str) -> None:
    """One pretty-printed JSON document; the writer adds the final newline."""
    report.select(F.rtrim(report_json(), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Report rows as JSON lines; the part files follow each other in order."""
    lines.write.mode("overwrite").json(path)


def export_files(df: DataFrame, rel_path: str, text: str, root: str) -> DataFrame:
    """Write each row to its own file below ``root`` (shared storage); returns ``rel_path, n_bytes``.

    Every file appears under its name only when complete, so retried or duplicated tasks
    leave the same result.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base, _ = storage(root)
        for batch in batches:
            sizes = []
            # one text at a time: a batch may hold many large ones
            for name, text in zip(batch.column("rel_path").to_pylist(), batch.column("text"), strict=True):
                content = text.as_py()
                target = f"{base.rstrip('/')}/{name}"
                folder, _, leaf = target.rpartition("/")
                system.create_dir(folder, recursive=True)
                data = content if isinstance(content, bytes) else content.encode("utf-8")
                part = f"{folder}/.{leaf}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(sizes, pa.int64())], ["rel_path", "n_bytes"])

    rows = df.select(F.col(rel_path).alias("rel_path"), F.col(text).alias("text"))
    with small_batches(df.sparkSession):
        return materialize(rows.mapInArrow(write, "rel_path string, n_bytes long"), "export")
