"""Document fingerprints: SimHash in DataFrame expressions only.

Terms are shingles of ``SHINGLE`` words; a term weighs as often as it occurs. Every term's 64-bit hash votes on the
bits of the fingerprint; votes are counted two to a long. :func:`near` finds all fingerprints within a Hamming radius through permuted
block tables: of ``radius + 2`` blocks of bits two agree in any such pair, and each choice of two is a table.

Defined cases: null is an empty text; an empty text has the zero fingerprint; fewer words than a shingle are one
term; the next document is the first row (by text hash) of the next larger doc_id, after the last of the first; rows
of one doc_id share their next document; a null doc_id has no next document, so its text stays unedited and
``near_next`` is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import WHITE
from bindery.operators.order import ranked, with_ordinal
from bindery.session import materialize

SHINGLE = 3
#: Two 32-bit counters to a long: no text has so many terms that they overflow.
LANES = 32
MASK = (1 << 32) + 1
RADIUS = 3


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, copies, fp`` of rows ``keys, text``: a bit is set if over half of the votes are for it.

    Terms are exploded and their votes summed at once, within generated code and before the shuffle; one row per
    document and task is exchanged. Rows with equal keys must have equal texts: their votes add up and ``copies`` counts
    them.
    """
    words = F.split(F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")), f"[{WHITE}]+")
    rows = rows.select(*keys, words.alias("_w"))
    ahead = [F.slice("_w", k + 1, 1 << 30).alias(f"w{k}") for k in range(SHINGLE)]
    rows = rows.select(*keys, F.posexplode(F.arrays_zip(*ahead)).alias("_at", "_t"))
    # a text of fewer words than a shingle is one term
    rows = rows.filter(F.col(f"_t.w{SHINGLE - 1}").isNotNull() | (F.col("_at") == 0))
    term = F.xxhash64(*[f"_t.w{k}" for k in range(SHINGLE)])
    rows = rows.select(*keys, "_at", F.when(F.col("_t.w0") != "", term).alias("_h"))
    votes = [F.expr(f"sum(shiftrightunsigned(_h, {i}) & {MASK}L)").alias(f"_v{i}") for i in range(LANES)]
    copies = F.count_if(F.col("_at") == 0).alias("copies")
    summed = rows.groupBy(*keys).agg(F.count("_h").alias("_n"), copies, *votes)
    bits = [(lane, place) for lane in range(LANES) for place in range(64 // LANES)]
    fp = " | ".join(
        f"if(2 * (shiftrightunsigned(_v{lane}, {LANES * place}) & {(1 << LANES) - 1}L) > _n, "
        f"shiftleft(1L, {lane + LANES * place}), 0L)"
        for lane, place in bits
    )
    return summed.select(*keys, "copies", F.expr(fp).alias("fp"))


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def near(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, n_near``: for each ``queries(fp)`` the rows of ``index(fp, copies)`` within the radius, its own included.

    Equal fingerprints are one row with a count on both sides, so a group of copies is compared once.
    """
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    masks = [a | b for a, b in itertools.combinations(single, 2)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]

    def keyed(rows: DataFrame) -> DataFrame:
        table = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
        return rows.withColumn("k", F.explode(table)).select("*", "k.t", "k.key").drop("k")

    wanted = keyed(queries.select("fp").distinct())
    held = keyed(index.groupBy("fp").agg(F.sum("copies").alias("n"))).withColumnRenamed("fp", "other")
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    pairs = wanted.join(held, ["t", "key"]).filter((F.bit_count(differ) <= radius) & (first == F.col("t")))
    return pairs.groupBy("fp").agg(F.sum("n").alias("n_near"))


def edited_fingerprints(docs: DataFrame, every: int = 100) -> DataFrame:
    """Fingerprints of every text, of its edited text (last quarter taken from the next document's beginning), and
    the number of other documents near it, searched for ids divisible by ``every``.

    Only beginnings of texts move to the document before, not whole texts; documents are placed in order by their
    ids alone, without a single-task sort.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    prints = base.withColumn("n_chars", F.char_length("text"))
    prints = materialize(fingerprints(prints, ["doc_id", "th", "n_chars"]), "fingerprints")
    searched = prints.filter(F.col("doc_id") % every == 0)
    around = near(searched, prints)
    known = prints.filter("doc_id is not null")
    base = base.filter("doc_id is not null")
    ids = known.groupBy("doc_id").agg(F.max("n_chars").alias("longest"), F.min(F.struct("th", "fp")).alias("first"))
    placed = materialize(with_ordinal(ranked(ids, [F.col("doc_id")], "ids"), "k"), "places")
    n = max(placed.count(), 1)
    after = placed.select(
        F.pmod(F.col("k") - 1, F.lit(n)).alias("k"),
        F.col("doc_id").alias("next_id"),
        F.col("first.th").alias("next_th"),
        F.col("first.fp").alias("next_fp"),
    )
    pairs = placed.select("k", "doc_id", F.floor(F.col("longest") / 4).cast("int").alias("take")).join(after, "k")
    pairs = materialize(pairs.drop("k"), "next-documents")
    asked = pairs.select(
        F.col("next_id").alias("doc_id"), "next_th", F.col("doc_id").alias("asker"), "take"
    )
    # texts are dealt by doc_id alone here and below, so that one exchange serves both joins
    first = F.col("th").bitwiseXOR(F.col("next_th")) == 0
    heads = base.join(asked, "doc_id").filter(first)
    heads = heads.select("asker", F.expr("substring(text, 1, take)").alias("head"))
    heads = heads.groupBy("asker").agg(F.min("head").alias("head")).withColumnRenamed("asker", "doc_id")
    rows = base.join(heads, "doc_id").withColumn("n_chars", F.char_length("text"))
    edited = F.expr(
        "concat(substring(text, 1, n_chars - cast(floor(n_chars / 4) as int)), "
        "substring(head, 1, cast(floor(n_chars / 4) as int)))"
    )
    lone = docs.filter("doc_id is null").select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    rows = rows.select("doc_id", "th", edited.alias("text")).unionByName(lone)
    rows = rows.withColumn("edited_sha256", F.sha2("text", 256))
    edits = fingerprints(rows, ["doc_id", "th", "edited_sha256"]).withColumnRenamed("fp", "edited_fp")
    own = prints.join(pairs.select("doc_id", "next_fp"), "doc_id", "left").join(around, "fp", "left")
    same = F.col("p.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("p.th") == F.col("e.th"))
    out = own.drop("copies").alias("p").join(edits.alias("e"), same)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "p.doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        hex64(F.col("fp")).alias("fingerprint"),
        hex64(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("p.doc_id") % every == 0, F.col("n_near") - 1).alias("n_near"),
    )
