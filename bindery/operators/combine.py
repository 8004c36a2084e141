"""Sections, ordered concatenation and word-budgeted bundles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as t
from bindery.operators.chunk import next_fit
from bindery.operators.order import ranked
from bindery.session import materialize

# Default separator and word limit of one bundle.
SEPARATOR = "\n\n---\n\n"
MAX_WORDS = 500_000
#: Characters of a text that stand in one row when bundles are written piece by piece.
PIECE_CHARS = 4 << 20


def build_sections(
    docs: DataFrame, corpus: Column, rel_path: Column, body: Column, add_source_header: bool = True
) -> DataFrame:
    """``corpus, rel_path, section, n_words`` with the body stripped and an optional source line."""
    rel_path, body = t.posix_path(rel_path), t.strip_text(body)
    section = t.with_source_header(rel_path, body) if add_source_header else body
    return docs.select(corpus.alias("corpus"), rel_path.alias("rel_path"), section.alias("section")).withColumn(
        "n_words", t.word_count("section")
    )


def concat_ordered(df: DataFrame, keys: list[str], order: str, text: str, separator: str, name: str) -> DataFrame:
    """Join the texts of each group in ``order``, ending in one newline.

    A group becomes one row, so groups must be bounded: chunks, not whole corpora.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("s"))))
    joined = F.array_join(F.transform(parts, lambda p: p["s"]), separator)
    return df.groupBy(*keys).agg(F.concat(joined, F.lit("\n")).alias(name), F.count("*").alias("n_sections"))


def separator_words(separator: str) -> int:
    return len(separator.split())


def seam_flags(section: Column, separator: str = SEPARATOR) -> Column:
    """Whether a section has text, starts with and ends in a word; null where it cannot matter."""
    if separator and not separator[0].strip() and not separator[-1].strip():
        return F.lit(None).cast("struct<filled boolean, starts boolean, ends boolean>")
    filled = section != ""
    return F.struct(
        filled.alias("filled"),
        (filled & ~section.rlike(f"^{t.SPACE_RE}")).alias("starts"),
        (filled & ~section.rlike(f"{t.SPACE_RE}\\z")).alias("ends"),
    )


def corpus_words(
    sections: DataFrame,
    order: Column,
    separator: str = SEPARATOR,
    seam: str | None = None,
    by: tuple[str, ...] = ("corpus",),
) -> DataFrame:
    """``corpus, total_words`` of the joined text, without joining it; ``by`` names other groups to join.

    Tokens that touch across a seam count once. With white space at both ends of the
    separator (the default) nothing can touch and the sum is exact as it stands. ``seam``
    names a column of :func:`seam_flags` when the text itself is not at hand.
    """
    sep_words, n = separator_words(separator), F.count("*")
    total = F.sum("n_words") + (n - 1) * sep_words
    head, tail = separator[:1].strip() != "", separator[-1:].strip() != ""
    if separator == "" or head or tail:
        flags = F.col(seam) if seam else seam_flags(F.col("section"), separator)
        filled, starts, ends = flags["filled"], flags["starts"].cast("long"), flags["ends"].cast("long")
        if separator == "":
            touching = F.greatest(F.count_if(filled) - 1, F.lit(0))
            total = total - F.least(touching, F.sum(ends) - F.max_by(ends, order))
        else:
            # an empty section lets the separators on both sides touch
            before = F.when(filled, ends).otherwise(F.lit(int(tail)))
            lone_lead = F.when(~F.min_by(filled, order) & (n > 1), F.lit(int(tail))).otherwise(F.lit(0))
            total = total - int(tail) * (F.sum(starts) - F.min_by(starts, order))
            total = total - int(head) * (F.sum(before) - F.max_by(before, order) - lone_lead)
    return sections.groupBy(*by).agg(total.cast("long").alias("total_words"))


def assign_chunks(
    sections: DataFrame,
    order: list[Column] | None = None,
    separator: str = SEPARATOR,
    max_words: int = MAX_WORDS,
    **tuning,
) -> DataFrame:
    """``corpus, rel_path, n_words, gid, chunk_no`` of every section; texts are never read.

    ``gid`` increases in section order (default: part-wise path order) within a corpus.
    """
    return next_fit(_placed(sections, order), max_words, separator_words(separator), **tuning)


def _placed(sections: DataFrame, order: list[Column] | None, *extra: str) -> DataFrame:
    # range partitioning samples its input first, so words are counted once and stored
    keys = materialize(sections.select("corpus", "rel_path", "n_words", *extra), "keys")
    return ranked(keys, [F.col("corpus"), *(order or [t.path_order("rel_path")])], "sections")


def gather_chunks(sections: DataFrame, numbers: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """``corpus, chunk_no, text, n_sections``: texts joined back to their chunk numbers.

    Texts move twice at most: to their number (not at all when the numbers are small
    enough to broadcast) and to their chunk, whose size the word limit bounds. A path must
    be unique in its corpus, like a file in a folder; a repeated one raises.
    """
    once = F.when(F.count("*") == 1, F.max("gid")).otherwise(
        F.raise_error(F.concat(F.lit("repeated path: "), F.col("rel_path"))).cast("long")
    )
    numbers = numbers.groupBy("corpus", "rel_path").agg(once.alias("gid"), F.max("chunk_no").alias("chunk_no"))
    numbered = sections.select("corpus", "rel_path", "section").join(numbers, ["corpus", "rel_path"])
    return concat_ordered(numbered, ["corpus", "chunk_no"], "gid", "section", separator, "text")


def combine(
    sections: DataFrame,
    order: list[Column] | None = None,
    *,
    separator: str = SEPARATOR,
    max_words: int = MAX_WORDS,
    stem: str = "combined",
    suffix: str = ".md",
    corpora: DataFrame | None = None,
    **tuning,
) -> DataFrame:
    """Bundles ``corpus, chunk_no, file_name, text, n_words, n_sections``.

    A corpus within the limit becomes one plainly named file; otherwise its chunks are
    numbered, even if there is only one. ``corpora`` lists corpora that must appear even
    when they have no section. ``sections`` is read twice (numbers, then texts), so it
    should come from stored text, not from a costly computation.
    """
    edges = [seam_flags(F.col("section"), separator).alias("seam")]
    placed = _placed(sections.select("corpus", "rel_path", "n_words", *edges), order, "seam")
    totals = corpus_words(placed, F.col("gid"), separator, seam="seam")
    # at most one corpus per max_words words, stored because it is used several times
    over = materialize(totals.filter(F.col("total_words") > max_words).select("corpus"), "over")
    narrow = placed.select("corpus", "rel_path", "gid", "n_words")
    split = next_fit(
        narrow.join(over, "corpus", "left_semi"), max_words, separator_words(separator), **tuning
    )
    whole = narrow.join(over, "corpus", "left_anti").withColumn("chunk_no", F.lit(None).cast("long"))
    numbers = whole.unionByName(split)
    chunks = gather_chunks(sections, numbers, separator)
    bundles = chunks.select(
        "corpus",
        F.coalesce("chunk_no", F.lit(1)).cast("long").alias("chunk_no"),
        F.when(F.col("chunk_no").isNull(), F.lit(stem + suffix))
        .otherwise(t.chunk_file_name(F.lit(stem), "chunk_no", F.lit(suffix)))
        .alias("file_name"),
        "text",
        t.word_count("text").alias("n_words"),
        F.col("n_sections").cast("long").alias("n_sections"),
    )
    if corpora is None:
        return bundles
    zero = F.lit(0).cast("long")
    empty = corpora.select("corpus").distinct().join(placed.select("corpus").distinct(), "corpus", "left_anti")
    return bundles.unionByName(
        empty.select(
            "corpus",
            F.lit(1).cast("long").alias("chunk_no"),
            F.lit(stem + suffix).alias("file_name"),
            F.lit("").alias("text"),
            zero.alias("n_words"),
            zero.alias("n_sections"),
        )
    )


class Pieces(NamedTuple):
    """Bundles of any size: ``files(rel_path, corpus, chunk_no, n_words, n_sections, n_bytes)`` and what stands where
    in them, ``pieces(rel_path, offset, text)``, by byte offset."""

    files: DataFrame
    pieces: DataFrame


def bundle_pieces(
    sections: DataFrame,
    order: list[Column] | None = None,
    *,
    separator: str = SEPARATOR,
    max_words: int = MAX_WORDS,
    stem: str = "combined",
    suffix: str = ".md",
    corpora: DataFrame | None = None,
    piece_chars: int = PIECE_CHARS,
    **tuning,
) -> Pieces:
    """The bundles of :func:`combine` without a row that holds one: every section knows its place in its file.

    Places are running sums of byte lengths over numbers alone; texts are joined to their places and cut to
    ``piece_chars``, so a bundle may outgrow a row (the word limit bounds words, not the bytes of a text without
    blanks). ``files`` has each file's words, sections and bytes; paths are ``corpus/file name``.
    """
    edges = [seam_flags(F.col("section"), separator).alias("seam"), F.octet_length("section").cast("long").alias("n_bytes")]
    placed = _placed(sections.select("corpus", "rel_path", "n_words", *edges), order, "seam", "n_bytes")
    totals = corpus_words(placed, F.col("gid"), separator, seam="seam")
    over = materialize(totals.filter(F.col("total_words") > max_words).select("corpus"), "over")
    split = next_fit(
        placed.select("corpus", "rel_path", "gid", "n_words").join(over, "corpus", "left_semi"),
        max_words,
        separator_words(separator),
        **tuning,
    )
    numbers = split.select("corpus", "gid", "chunk_no")
    name = F.when(F.col("chunk_no").isNull(), F.lit(stem + suffix)).otherwise(
        t.chunk_file_name(F.lit(stem), "chunk_no", F.lit(suffix))
    )
    named = placed.join(numbers, ["corpus", "gid"], "left").withColumn("rel_path_in", F.col("rel_path"))
    named = materialize(named.withColumn("rel_path", F.concat_ws("/", "corpus", name)), "named")

    sep_bytes = len(separator.encode())
    in_file = Window.partitionBy("rel_path").orderBy("gid")
    before = F.sum(F.col("n_bytes") + sep_bytes).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    first, last = F.lag("gid").over(in_file).isNull(), F.lead("gid").over(in_file).isNull()
    places = named.select(
        "corpus",
        "rel_path_in",
        "rel_path",
        F.when(first, F.lit(0)).otherwise(before - sep_bytes).cast("long").alias("offset"),
        first.alias("first"),
        last.alias("last"),
    )
    once = F.when(F.count("*") == 1, F.max(F.struct("rel_path", "offset", "first", "last"))).otherwise(
        F.raise_error(F.concat(F.lit("repeated path: "), F.col("rel_path_in"))).cast(
            "struct<rel_path string, offset bigint, first boolean, last boolean>"
        )
    )
    places = places.groupBy("corpus", "rel_path_in").agg(once.alias("at"))
    texts = sections.select("corpus", F.col("rel_path").alias("rel_path_in"), "section").join(places, ["corpus", "rel_path_in"])
    whole = F.concat(
        F.when(F.col("at.first"), F.lit("")).otherwise(F.lit(separator)),
        "section",
        F.when(F.col("at.last"), F.lit("\n")).otherwise(F.lit("")),
    )
    texts = texts.select("at.rel_path", "at.offset", whole.alias("text"))
    cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / piece_chars).cast("int"))
    cut = texts.select("rel_path", "offset", "text", F.explode(cuts).alias("nth"))
    start = F.col("nth") * piece_chars
    ahead = F.when(F.col("nth") == 0, F.lit(0)).otherwise(F.octet_length(F.substring("text", F.lit(1), start)))
    pieces = cut.select(
        "rel_path", (F.col("offset") + ahead).alias("offset"), F.substring("text", start + 1, F.lit(piece_chars)).alias("text")
    )

    words = corpus_words(named, F.col("gid"), separator, seam="seam", by=("rel_path",))
    n = F.count("*")
    sizes = named.groupBy("rel_path").agg(
        F.first("corpus").alias("corpus"),
        F.coalesce(F.first("chunk_no"), F.lit(1)).cast("long").alias("chunk_no"),
        n.alias("n_sections"),
        (F.sum("n_bytes") + (n - 1) * sep_bytes + 1).alias("n_bytes"),
    )
    columns = ["rel_path", "corpus", "chunk_no", F.col("total_words").alias("n_words"), "n_sections", "n_bytes"]
    files = sizes.join(words, "rel_path").select(*columns)
    if corpora is not None:
        empty = corpora.select("corpus").distinct().join(files.select("corpus"), "corpus", "left_anti")
        zero = F.lit(0).cast("long")
        none = [zero.alias(c) for c in ("n_words", "n_sections", "n_bytes")]
        path = F.concat_ws("/", "corpus", F.lit(stem + suffix)).alias("rel_path")
        files = files.unionByName(empty.select(path, "corpus", F.lit(1).cast("long").alias("chunk_no"), *none))
    return Pieces(materialize(files, "bundle-files"), pieces)
