"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by (source, key), distributed prefix sums of
their sizes are taken per source, and each source is cut at its exact budget, after whole epochs where the budget
exceeds the source.

Defined cases: null and empty texts have size 0 and are never drawn; a null source is a source of its own, ordered
last; an empty table gives an empty result; documents with one doc_id are separate documents ordered by size;
other columns are carried through by :func:`draw` unless they clash with its ``epoch`` and ``take``, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import WHITE, WORD, running_sum
from bindery.operators.order import ranked, with_ordinal
from bindery.session import materialize

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 17


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def budgets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``_group, source_size, target, quota`` per source of ``sized(_group, source, size)``.

    Sources in code point order (null last) weigh ``weights`` in turn. The whole size is shared by weight; what a
    source cannot take, being held to ``cap`` times its size, is shared again until none is above. Only three
    numbers per round reach the driver, however many sources there are.
    """
    totals = sized.groupBy("_group", "source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    places = with_ordinal(ranked(totals, order, "sources"), "_place")
    by_place = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = materialize(places.withColumn("_w", by_place.cast("double")), "weights")
    total, every = (x or 0 for x in weighed.agg(F.sum("source_size"), F.sum("_w")).first())
    spent, free = 0.0, float(every)

    def capped(spent: float, free: float) -> Column:
        return cap * F.col("source_size") * F.lit(free) < F.col("_w") * F.lit(total - spent)

    while total:
        full = capped(spent, free)
        held, rest = weighed.agg(
            F.sum(F.when(full, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_w")))
        ).first()
        if (float(held), float(rest)) == (spent, free):
            break
        spent, free = float(held), float(rest)
    share = F.col("_w") * F.lit(float(total) - spent) / F.lit(free or 1.0)
    target = F.when(capped(spent, free), (cap * F.col("source_size")).cast("double")).otherwise(share)
    return weighed.select("_group", "source_size", target.alias("target")).withColumn(
        "quota", F.floor("target").cast("long")
    )


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")


def mixture(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document: ``doc_id, source, size, source_size, target, epochs, rest, taken``.

    ``epochs`` whole copies and a last one of ``rest`` words; ``taken`` is their sum. Per source, ``taken`` adds
    up to the whole part of ``target``.
    """
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _group().alias("_group"))
    sized = materialize(narrow.withColumn("_key", _key(seed)), "sizes")
    plan = budgets(sized, weights, cap)
    summed = running_sum(sized, "_group", [F.col("_key"), F.col("doc_id"), F.col("size")], "size", "prefix")
    joined = summed.join(plan, "_group").withColumn("epochs", _epochs())
    left = F.col("quota") - F.col("epochs") * F.col("source_size") - F.col("before")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    joined = joined.withColumn("rest", rest).withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", "taken", "_key")


def draw(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mixed documents: one row per copy, with ``epoch`` (from 0) and ``take`` (words of this copy).

    The text of a copy cut at the budget is its first ``take`` words. Texts are not moved: each source has one
    cut, (key, doc_id, size), that all its documents are held against.
    """
    mixed = materialize(mixture(docs, weights, cap, seed).withColumn("_group", _group()), "mixture")
    # the last document reached in the final epoch, one per source
    reached = F.when(F.col("rest") > 0, F.struct("_key", "doc_id", "size", "rest"))
    cuts = mixed.groupBy("_group").agg(F.max("epochs").alias("_epochs"), F.max(reached).alias("_cut"))
    own = F.struct(F.col("_key"), F.col("doc_id"), F.col("_size").alias("size"))
    cut = F.struct("_cut._key", "_cut.doc_id", "_cut.size")
    rest = F.when(own < cut, F.col("_size")).when(own == cut, F.col("_cut.rest")).otherwise(F.lit(0))
    rows = docs.drop("epoch", "take").withColumn("_group", _group()).withColumn("_size", n_words(F.col("text")))
    rows = rows.withColumn("_key", _key(seed)).filter("_size > 0").join(cuts, "_group")
    rows = rows.withColumn("_rest", F.coalesce(rest, F.lit(0)))
    last = F.col("_epochs") + F.when(F.col("_rest") > 0, 1).otherwise(0)
    rows = rows.withColumn("_n", last).filter("_n > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = rows.withColumn("take", F.when(F.col("epoch") < F.col("_epochs"), F.col("_size")).otherwise(F.col("_rest")))
    words = F.split(F.regexp_replace("text", f"^[{WHITE}]+", ""), f"[{WHITE}]+")
    short = F.array_join(F.slice(words, 1, F.col("take").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("take") < F.col("_size"), short).otherwise(F.col("text")))
    return rows.drop("_group", "_size", "_key", "_epochs", "_cut", "_rest", "_n")
