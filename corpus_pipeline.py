"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes as Parquet and rereads
as the next stage's ``docs``. All but the last keep the columns of ``documents``. A stage sees only what the stage
before it kept.

Nulls, empty texts and repeated rows pass through as each operator defines: a null text, or one without a letter, is
rejected by the first stage, a repeated row by the second; a document cut to nothing stays, empty, until the last stage,
where it is its end token; documents without an id are kept, never cut, and packed with a null id; an empty table stays
empty. Further columns of the documents are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import langid, mixing, packing, pivots, suffixes
from bindery.llm.common import fresh
from bindery.session import materialize

#: A document whose largest language holds less than this share is no text of any learned language.
LEAST_SHARE = 0.5


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    return docs.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a language: no letter, or no language with half of the text."""
    languages, model = langid.train(docs)
    # results under names that no column of the documents has
    names = tuple(fresh(n, docs.columns) for n in ("lang_pred", "score", "languages"))
    rows = langid.predict(docs, languages, model, docs.columns, names)
    known = (F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SHARE)
    # with nothing to learn from, nothing can be rejected but texts without a letter
    kept = rows.filter(known) if languages else docs.filter(F.col("text").rlike(r"\p{L}"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return pivots.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller doc_id holds."""
    return _sized(suffixes.remove_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents to the target weights; a document drawn again is a row again."""
    return _sized(mixing.draw(docs).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the drawn documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

# language ID is learned by iteration and SimHash needs XXH64: no SQL for run()
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
