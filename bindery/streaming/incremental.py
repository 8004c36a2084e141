"""Incremental conversion: each run handles only the files that arrived since the last."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.markdown import STRIP_CLASSES, STRIP_TAGS
from bindery.functions.text import markdown_path, path_order
from bindery.operators.convert import DUPLICATE, SAME_NAME, convert_marked
from bindery.operators.order import ranked, with_ordinal
from bindery.sources.files import FILE_SCHEMA, as_html_files
from bindery.sources.storage import LISTED, is_missing, list_files, reached, with_content
from bindery.streaming.names import least_owners, run_once, stream_settings

_SUFFIXES = (".html", ".htm")
_NOTED = f"{LISTED}, modified long"
#: Names that Spark's file source passes over, of files and of folders.
_HIDDEN = r"(^|/)(\.|_(?!metadata|common_metadata)[^=/]*(/|$))"
_TEXT = ("markdown", "n_words", "n_bytes", "region")


def _if_there(load: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return load()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def note_new_files(spark: SparkSession, root: str, checkpoint: str, max_files_per_batch: int) -> str | None:
    """Add the files below ``root`` that are new to the checkpoint's own listing; where that is, or None if it is empty.

    Each of its Parquet files holds at most ``max_files_per_batch`` names, the oldest first, and is one micro-batch. What
    a broken run leaves is noted: its files are whole, and the others are still new. Names of Spark's file source, which
    a checkpoint from before there was a listing holds, are known too.
    """
    noted = f"{checkpoint}/listing"
    listed = list_files(spark, root, _SUFFIXES).filter(~F.col("rel_path").rlike(_HIDDEN))
    before = _if_there(lambda: spark.read.schema(_NOTED).parquet(noted))
    log = _if_there(lambda: spark.read.text(f"{checkpoint}/sources/0"))
    known = [] if before is None else [before.select("path")]
    if log is not None:
        uri = F.get_json_object("value", "$.path")
        path = F.try_url_decode(F.regexp_replace(uri, r"\+", "%2B"))
        known.append(log.filter(uri.isNotNull()).select(F.regexp_replace(path, "^file:/+", "file:/").alias("path")))
    for names in known:
        listed = listed.join(names, "path", "left_anti")
    new = ranked(listed, [F.col("modified"), F.col("path")], "new-files")
    if new.isEmpty():
        return noted if before is not None else None
    # without a column for it, rows of two parts could share a file, and an empty task would leave one
    parts = with_ordinal(new, "part").withColumn("part", F.floor(F.col("part") / max_files_per_batch))
    parts.repartition("part").write.mode("append").partitionBy("part").parquet(noted)
    return noted


def convert_new_files(
    spark: SparkSession,
    root: str,
    output: str,
    checkpoint: str,
    strip_tags: Sequence[str] = STRIP_TAGS,
    strip_classes: Sequence[str] = STRIP_CLASSES,
    max_files_per_batch: int = 100_000,
) -> None:
    """Convert everything new below ``root`` into ``output`` and stop.

    The checkpoint's listing, a table, remembers what was seen, and the stream's state who holds a Markdown name, so a run
    costs what is new, and the driver knows a file of names for each micro-batch where Spark's file source keeps every
    file that it ever saw. Contents are read once names are settled, and only of files that hold theirs. Each
    micro-batch overwrites its own ``batch`` folder, so a replayed batch after a failure does not duplicate rows. A file
    that takes a name from one of an earlier batch says so in ``instead``. Empty files and hidden names do not take part.
    Storage that Arrow does not reach is left to Spark's file source.
    """
    by_name = reached(root) and not is_missing(root)  # a folder that is not there is reported by Spark
    if by_name:
        noted = note_new_files(spark, root, checkpoint, max_files_per_batch)
        if noted is None:
            return
        names = spark.readStream.schema(_NOTED).option("maxFilesPerTrigger", 1).parquet(noted)
        files = names.filter("n_bytes > 0").select(F.col("path").alias("key"), "rel_path", "n_bytes")
    else:
        stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
        found = stream.option("pathGlobFilter", "*.{html,htm}").option("maxFilesPerTrigger", max_files_per_batch).load(root)
        files = as_html_files(found, root)
    named = files.withColumn("md_path", markdown_path("rel_path")).withColumn("rank", path_order("rel_path"))
    settled = least_owners(named, "md_path", "rank", "key", "n_bytes" if by_name else "content")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if by_name:
            listed = batch.select(F.col("key").alias("path"), "n_bytes", "lost", "instead")
            batch = as_html_files(with_content(listed, root), root, ["lost", "instead"])
        done = convert_marked(batch, strip_tags, strip_classes, ["instead"])
        done.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    with stream_settings(spark):
        run_once(settled, checkpoint, write_batch)


def read_converted(spark: SparkSession, output: str) -> DataFrame | None:
    """All rows converted so far with their ``batch``, or None before the first run.

    Of files that share a Markdown name the first path wins whatever batch it came in, so
    the cut into batches does not show; the others are duplicates without text.
    """
    rows = _if_there(lambda: spark.read.parquet(output))
    if rows is None:
        return None
    # only owners of earlier batches that lost their name: few, and sized at run time
    replaced = rows.filter("instead is not null").select(F.col("instead").alias("key"), F.lit(True).alias("_lost"))
    marked = rows.join(replaced, "key", "left")
    values = {
        "status": F.when(F.col("_lost"), F.lit(DUPLICATE)).otherwise(F.col("status")),
        "error": F.when(F.col("_lost"), F.lit(SAME_NAME)).otherwise(F.col("error")),
        **{c: F.when(F.coalesce("_lost", F.lit(False)), None).otherwise(F.col(c)) for c in _TEXT},
    }
    return marked.select(*[values.get(c, F.col(c)).alias(c) for c in rows.columns if c != "instead"])
